import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with an extra column and names that operators use inside."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(d, t, "en", f"s{(d or 0) % 3}", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(data, schema).repartition(3)
        if extra:
            for name in ("uid", "name", "h", "size", "key", "n_words", "rep", "score", "best"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(None).cast("string"))
        return df

    return make


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
