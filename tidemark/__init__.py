"""Vessel evidence engine: composable DataFrame operators on Spark."""
