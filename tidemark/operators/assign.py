"""One-to-one assignment: as many pairs as possible, then the least total distance."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import components
from tidemark.staging import Staged

#: Nearest candidates that every row is solved on first; rows for which these may not be enough get four times as many.
NEAREST = 16
#: Ranked candidates of a row that are written; rows that need more are ranked again.
HELD = 64
#: Pairs of a scene that one task solves; of more the components are dealt to as many tasks as needed.
PART = 262144
#: Tolerances of a line that one task solves.
BLOCK = 10


def least_cost(cost: np.ndarray) -> np.ndarray:
    """For each row its column in a minimum-cost assignment; rows must not outnumber columns.

    Rows are added one at a time along the cheapest augmenting path under dual prices.
    """
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        row, came = start, np.full(m, -1)
        best, done, last = np.full(m, np.inf), np.zeros(m, bool), -1
        tree = [start]
        reached = {start: 0.0}
        total = 0.0
        while True:
            reduced = total + cost[row] - row_price[row] - col_price
            better = ~done & (reduced < best)
            best[better] = reduced[better]
            came[better] = last
            last = int(np.argmin(np.where(done, np.inf, best)))
            total = best[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
            tree.append(row)
            reached[row] = total
        for r in tree:
            row_price[r] += total - reached[r]
        col_price[done] -= total - best[done]
        while last >= 0:
            before = came[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def cheapest(at: np.ndarray, to: np.ndarray, cost: np.ndarray, n_rows: int, n_cols: int, alone: int) -> tuple[np.ndarray, list[int]]:
    """For each row its edge (or -1) in the cheapest assignment, and each row's price; a row left alone costs ``alone``.

    Edges are sorted by row, then by cost; costs are non-negative whole numbers, so sums and comparisons are exact.
    Rows are added one at a time along the cheapest augmenting path, and a path looks only at edges shorter than
    what ends it: work and memory follow the edges near a conflict, never rows times columns.
    """
    starts = np.searchsorted(at, np.arange(n_rows + 1)).tolist()
    row_price, col_price = [0] * n_rows, [0] * n_cols
    owner, taken = [-1] * n_cols, [-1] * n_rows
    for start in range(n_rows):
        reached, came, done, heap = {start: 0}, {}, [], []
        best: dict[int, int] = {}
        end, end_row, end_edge = alone, start, -1
        row, so_far = start, 0
        while True:
            base = so_far - row_price[row]
            if base + alone < end:
                end, end_row, end_edge = base + alone, row, -1
            low, high = starts[row], starts[row + 1]
            while low < high:  # by portions: most rows are done after a few edges
                upto = min(high, low + 16)
                for e, c, d in zip(range(low, upto), to[low:upto].tolist(), cost[low:upto].tolist()):
                    if base + d >= end:
                        upto = high
                        break
                    if owner[c] < 0:
                        end, end_row, end_edge = base + d, row, e
                        upto = high
                        break
                    label = base + d - col_price[c]
                    if label < end and label < best.get(c, end):
                        best[c] = label
                        came[c] = (row, e)
                        heapq.heappush(heap, (label, c))
                low = upto
            while heap and heap[0][0] > best[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            so_far, col = heapq.heappop(heap)
            done.append((col, so_far))
            row = owner[col]
            reached[row] = so_far
        for r, label in reached.items():
            row_price[r] += end - label
        for c, label in done:
            col_price[c] -= end - label
        row, edge = end_row, end_edge
        while True:
            before = taken[row]
            taken[row] = edge
            if edge >= 0:
                owner[to[edge]] = row
            if row == start:
                break
            row, edge = came[int(to[before])]
    return np.array(taken, np.int64), row_price


def solve_part(left: np.ndarray, right: np.ndarray, distance: np.ndarray, farthest: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges chosen (positions), then the distinct left sides, and for each the distance up to which a further edge could help.

    ``farthest`` is the longest distance of all edges, where only some are given.
    """
    names, at = np.unique(left, return_inverse=True)
    cols, to = np.unique(right, return_inverse=True)
    order = np.lexsort((to, distance, at))
    top = max(float(distance.max(initial=0.0)), farthest)
    digits = 52 - int(np.frexp(top)[1])  # whole numbers below 2 ** 52
    cost = np.ldexp(distance, digits).round().astype(np.int64)
    alone = (int(np.ldexp(top, digits)) + 1) * (len(names) + 1)  # a pair more beats any distance saved
    taken, price = cheapest(at[order], to[order], cost[order], len(names), len(cols), alone)
    limit = np.array([float(p) for p in price]) * 2.0**-digits
    return np.sort(order[taken[taken >= 0]]), names, limit


def solve(left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> list[int]:
    """Positions of the chosen edges; the side with fewer members is assigned to the other."""
    if len(np.unique(left)) > len(np.unique(right)):
        left, right = right, left
    return solve_part(left, right, np.asarray(distance, float))[0].tolist()


class Group:
    """The given pairs of a part of one scene, sorted out into rows and columns."""

    def __init__(self, table: pa.Table):
        self.table = table
        det = table.column("det_id").to_numpy()
        named = pc.dictionary_encode(table.column("mmsi").combine_chunks(), null_encoding="encode")
        named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
        rank = np.empty(len(named.dictionary), np.int64)
        rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(rank))
        ship = rank[named.indices.to_numpy()]
        self.left, self.right = (det, ship) if table.column("by_det")[0].as_py() else (ship, det)
        self.distance = table.column("distance_m").to_numpy()
        self.farthest = pc.max(table.column("far")).as_py()
        self.names, self.first, mine = np.unique(self.left, return_index=True, return_inverse=True)
        self.last = np.zeros(len(self.names))
        np.maximum.at(self.last, mine, self.distance)
        self.partial = np.bincount(mine, minlength=len(self.names)) < table.column("n").to_numpy()[self.first]

    def solve(self, most: float = np.inf, kept: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of the ``kept`` pairs up to ``most`` apart the chosen ones, and of each row that may need more of its pairs the first.

        All pairs of a row up to its last one are there; a row that would not pay as much needs no further ones. A row of which
        none is kept would pay anything.
        """
        near = np.flatnonzero((self.distance <= most) & kept)
        chosen, names, limit = solve_part(self.left[near], self.right[near], self.distance[near], self.farthest)
        pays = np.full(len(self.names), np.inf)
        pays[np.searchsorted(self.names, names)] = limit
        return near[chosen], self.first[self.partial & (pays > self.last) & (self.last <= most)]


def _solved(table: pa.Table) -> pa.Table:
    """The chosen pairs of a part, and (with ``more``) a pair of each row that may need pairs beyond those given."""
    chosen, short = Group(table).solve()
    picked = table.take(pa.array(np.concatenate([chosen, short]))).select(["scene", "det_id", "mmsi", "distance_m", "key"])
    return picked.append_column("more", pa.array(np.arange(len(picked)) >= len(chosen)))


def _solved_within(table: pa.Table, cuts: dict[int, list[float]]) -> pa.Table:
    """matched and total_m of a part for each tolerance of its block, and (with ``more``) the rows that may need further pairs."""
    side = "det_id" if table.column("by_det")[0].as_py() else "mmsi"
    table = table.sort_by([(side, "ascending"), ("distance_m", "ascending")])
    group, short, told = Group(table), set(), []
    kept, block = table.column("kept").to_numpy(), table.column("block")[0].as_py()
    for most in cuts[block]:
        chosen, rows = group.solve(most, kept)
        short.update(rows.tolist())
        told.append((most, len(chosen), float(group.distance[chosen].sum())))
    keys = table.column(side).take(pa.array(sorted(short), pa.int64())).cast(pa.string()).to_pylist()
    n, k = len(told), len(keys)
    return pa.table(
        {
            "scene": pa.array([table.column("scene")[0].as_py()] * (n + k), pa.string()),
            "block": pa.array([block] * (n + k), pa.int32()),
            "tolerance_m": pa.array([t[0] for t in told] + [None] * k, pa.float64()),
            "matched": pa.array([t[1] for t in told] + [None] * k, pa.int64()),
            "total_m": pa.array([t[2] for t in told] + [None] * k, pa.float64()),
            "key": pa.array([None] * n + keys, pa.string()),
            "more": pa.array([False] * n + [True] * k),
        }
    )


def _sides(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs without rivals, then (scene, by_det) and, of the other pairs, the members (scene, key, n, far) of the scene's smaller side.

    ``n`` is a row's number of pairs and ``far`` its longest distance. All is told by one line for each detection and vessel.
    """
    told = [F.count("*").alias("n"), F.max("distance_m").alias("far")]
    dets = Staged(pairs.groupBy("scene", "det_id").agg(*told), "dets").df
    ships = Staged(pairs.groupBy("scene", "mmsi").agg(*told, F.min("det_id").alias("only")), "ships").df
    free = dets.where("n = 1").select(F.col("scene").alias("__scene"), "det_id")
    lone = ships.where("n = 1").join(free, _same(scene="__scene", only="det_id")).select("scene", "det_id", "mmsi", F.col("far").alias("distance_m"))
    lone = Staged(lone, "lone").df
    counts = dets.groupBy("scene").agg(F.count("*").alias("__dets")).join(ships.groupBy(F.col("scene").alias("__scene")).agg(F.count("*").alias("__ships")), _same(scene="__scene"))
    sides = Staged(counts.select("scene", (F.col("__dets") < F.col("__ships")).alias("by_det")), "sides").df
    rows = None
    for by_det, members, name in ((True, dets, "det_id"), (False, ships, "mmsi")):
        here = sides.where(F.col("by_det") == by_det).select(F.col("scene").alias("__scene"))
        taken = lone.select(F.col("scene").alias("__scene"), F.col(name).alias("__name"))
        own = members.join(F.broadcast(here), _same(scene="__scene"), "left_semi").join(taken, _same(**{"scene": "__scene", name: "__name"}), "left_anti")
        own = own.select("scene", F.col(name).cast("string").alias("key"), "n", "far")
        rows = own if rows is None else rows.unionByName(own)
    return lone, sides, rows


def _same(**columns: str) -> Column:
    """Equality of the left columns with the right ones, NULL with NULL."""
    out = F.lit(True)
    for left, right in columns.items():
        out = out & F.col(left).eqNullSafe(F.col(right))
    return out


def _of_rows(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of the given rows, with what is known of these."""
    names = rows.select(F.col("scene").alias("__scene"), F.col("key").alias("__key"), "n", "far", "most")
    return ranked.join(names, _same(scene="__scene", key="__key")).drop("__scene", "__key")


def _in_parts(given: DataFrame, rows: DataFrame) -> DataFrame:
    """``given`` with the ``part`` of its scene that a pair is solved in.

    Scenes of many pairs are cut into parts that share no row and no column: components of the pairs, dealt by hash.
    """
    sizes = rows.groupBy(F.col("scene").alias("__scene")).agg(F.ceil(F.sum(F.least("n", "most")) / F.lit(PART)).cast("int").alias("__parts"))
    if not sizes.where("__parts > 1").limit(1).count():
        return given.withColumn("part", F.lit(0))
    given = given.join(F.broadcast(sizes), _same(scene="__scene")).drop("__scene")
    # Equal hashes of two rows or two columns only join their components.
    other = F.when(F.col("by_det"), F.col("mmsi")).otherwise(F.col("det_id").cast("string"))
    given = Staged(given.withColumns({"__row": F.xxhash64("scene", "key"), "__col": F.xxhash64("scene", other)}), "given").df
    own = given.where("__parts > 1").select(F.col("__row").alias("a"), "__col")
    links = own.join(own.groupBy("__col").agg(F.min("a").alias("b")), "__col").select("a", "b").where("a <> b").distinct()
    labels = components(links)
    given = given.join(labels, F.col("__row") == F.col("node"), "left")
    part = F.pmod(F.xxhash64(F.coalesce("label", "__row")), F.col("__parts")).cast("int")
    return given.withColumn("part", part).drop("node", "label", "__row", "__col", "__parts")


def _rounds(pairs: DataFrame, sides: DataFrame, rows: DataFrame, run, shape: str, spread=None, by: tuple[str, ...] = ("scene", "part")) -> DataFrame:
    """What ``run`` tells of each part of a scene, once every row has the pairs that it needs, with ``more`` false.

    A row is a member of the scene's smaller side. ``spread`` repeats the pairs that are to be solved, under further columns of ``by``.
    """
    turned = pairs.join(F.broadcast(sides.withColumnRenamed("scene", "__scene")), _same(scene="__scene")).drop("__scene")
    turned = turned.withColumn("key", F.when(F.col("by_det"), F.col("det_id").cast("string")).otherwise(F.col("mmsi")))
    rank = F.row_number().over(Window.partitionBy("scene", "key").orderBy("distance_m", "det_id", "mmsi"))
    held = Staged(turned.withColumn("rank", rank).where(F.col("rank") <= HELD), "ranked")
    rows = Staged(rows.withColumn("most", F.lit(NEAREST)), "rows")
    most = NEAREST
    while True:
        given = _of_rows(held.df, rows.df.where(F.col("most") <= HELD)).where(F.col("rank") <= F.col("most"))
        if most > HELD:  # of few rows: their pairs are ranked anew
            beyond = _of_rows(turned, rows.df.where(F.col("most") > HELD)).withColumn("rank", rank)
            given = given.unionByName(beyond.where(F.col("rank") <= F.col("most")))
        given = _in_parts(given.drop("rank"), rows.df).drop("most")
        given = spread(given) if spread else given
        solved = Staged(given.groupBy(*by).applyInArrow(run, f"{shape}, key string, more boolean"), "assigned")
        more = solved.df.where("more").select(F.col("scene").alias("__scene"), F.col("key").alias("__key"), F.lit(True).alias("__more")).distinct()
        if not more.limit(1).count():
            held.drop()
            return solved.df
        most *= 4
        wanted = rows.df.join(more, _same(scene="__scene", key="__key"), "left").drop("__scene", "__key")
        rows = Staged(wanted.withColumn("most", F.when(F.col("__more"), F.lit(most)).otherwise(F.col("most"))).drop("__more"), "rows")


def assign(candidates: DataFrame) -> DataFrame:
    """The chosen (scene, det_id, mmsi, distance_m) among candidate pairs; of equally good choices, the same on every run.

    A pair whose two sides have no other candidate is taken without leaving the JVM. The rest is solved scene by
    scene on each row's nearest candidates, large scenes in parts that share no vessel and no detection. Where the
    prices of the solution prove that no omitted pair could improve it, within a part or between parts, it is the
    optimum over all pairs; the rows where they do not get four times as many candidates, up to all of theirs, and
    the scene is solved again.
    """
    columns = ["scene", "det_id", "mmsi", "distance_m"]
    pairs = Staged(candidates.select(*columns), "candidates")
    lone, sides, rows = _sides(pairs.df)
    solved = _rounds(pairs.df, sides, rows, _solved, "scene string, det_id long, mmsi string, distance_m double")
    pairs.drop()
    return lone.unionByName(solved.select(*columns))


def assign_within(candidates: DataFrame, lines: list[tuple[int, int, float, list[float]]]) -> DataFrame:
    """(line, tolerance_m, matched, total_m): the assignments under each line's tolerances, summed over scenes.

    Candidates are (family, scene, det_id, mmsi, distance_m, age), where scenes of different families have different names.
    A line is (line, family, most_age, tolerances): it takes the vessels of its family that are no older than ``most_age``.
    A family's candidates are ranked once for all its lines; only each row's nearest ones are repeated for them, under blocks of
    ``BLOCK`` tolerances at most.
    """
    blocks = [(line, family, float(age), cuts[i :: -(-len(cuts) // BLOCK)]) for line, family, age, cuts in lines for i in range(-(-len(cuts) // BLOCK))]
    cuts_of = {i: b[3] for i, b in enumerate(blocks)}
    told = candidates.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(blocks)], "block int, line int, family int, most_age double, cuts array<double>")
    pairs = Staged(candidates.select("family", "scene", "det_id", "mmsi", "distance_m", "age"), "candidates")
    lone, sides, rows = _sides(pairs.df)
    alone = lone.drop("distance_m").join(pairs.df, ["scene", "det_id", "mmsi"]).join(F.broadcast(told), "family").where("age <= most_age")
    alone = alone.select("line", F.explode("cuts").alias("tolerance_m"), "distance_m").where("distance_m <= tolerance_m")
    alone = Staged(alone.groupBy("line", "tolerance_m").agg(F.count("*").alias("matched"), F.sum("distance_m").alias("total_m")), "alone").df

    def spread(given: DataFrame) -> DataFrame:
        """A vessel is in a line with all its pairs or none; a detection's row also needs those left out, to tell how far it was given."""
        given = given.join(F.broadcast(told.drop("cuts", "line")), "family").withColumn("kept", F.col("age") <= F.col("most_age")).where("kept or by_det")
        return given.select("block", "scene", "part", "det_id", "mmsi", "distance_m", "by_det", "n", "far", "kept")

    shape = "scene string, block int, tolerance_m double, matched long, total_m double"
    solved = _rounds(pairs.df, sides, rows, lambda table: _solved_within(table, cuts_of), shape, spread, ("block", "scene", "part"))
    pairs.drop()
    solved = solved.join(F.broadcast(told.select("block", "line")), "block")
    both = solved.select("line", "tolerance_m", "matched", "total_m").unionByName(alone)
    return both.groupBy("line", "tolerance_m").agg(F.sum("matched").alias("matched"), F.sum("total_m").alias("total_m"))
