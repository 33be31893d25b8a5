"""SimHash near-dedup with deletion-variant signatures.

A text's words (A-Z lower-cased, split at ASCII white space) form shingles; each shingle's XXH64 votes on the
bits of a fingerprint of one or more 64-bit lanes (further lanes mix the same hash anew). Fingerprints link at
``max_bits`` or fewer differing bits.

Candidates: every lane is cut into three segments. With one lane and at most five differing bits some segment
differs by one bit at most, so the two fingerprints agree on that segment with one bit - the wildcard - taken
out. The index holds all one-wildcard variants of all segments, 64 a lane. The variants of a segment whose wildcard
is in the same third of it agree in the other two thirds, so they travel as one row with these as key, nine rows a
lane; a task makes the variants of the rows of a key, brings equal ones together and verifies every candidate on
the whole fingerprint. Only distinct fingerprints are indexed, so exact copies cost nothing.

Large buckets: a bucket of m fingerprints yields a spanning forest of its links - m - 1 edges at most, never
all pairs - and a task drops edges whose ends it has joined already. Where a key has more than ``run`` rows or a
variant more than ``bucket``, its variants are shuffled one by one. Variants that are still too large are split
again by one-wildcard variants of the lane's other bits (one lane), which loses no link, and what is left is cut
into tiles (pairs of bounded chunks) that are searched as groups of their own; nothing is dropped. Components then
join the edges in Spark.

Near copies by overlap (``near_copies``, the pipeline's stage): the fingerprint finds candidates, the texts
decide. Four lanes of two-word shingles differ in 0.10 of their bits, seldom 0.15, where sets of five-word
shingles overlap by 0.8, and some of the twelve segments differs by one bit at most. Candidates form groups;
within a group every text is compared in full - the sizes of intersections of whole shingle sets are counted -
with all texts that it is not yet linked to, in tiles of bounded chunks. So no link is below ``overlap`` and no
link inside a group is lost. Groups are small unless texts are alike; in a group of m texts off one base that
do not link, the work grows with m squared, at about a nanosecond for each shingle of each pair.

Defined cases: null and empty texts have fingerprint zero and are linked; fewer words than a shingle form one
shingle; rows without doc_id take part in no link of their own and report the component of equal fingerprints
(in ``near_copies`` of equal words); rows that repeat a doc_id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, Staged, components, stage

SEED = 42
#: The first bit of each segment of a lane, and the end.
CUTS = (0, 21, 42, 64)
#: The first bit and the width of each third of each segment.
THIRDS = [(low + 7 * i, high - low - 14 if i == 2 else 7) for low, high in zip(CUTS, CUTS[1:]) for i in range(3)]
#: As CUTS for what is left of a lane without one segment, where large buckets are split again.
REST_CUTS = (0, 14, 28, 43)
CHUNK = 1 << 14
#: So many ids, 8 bytes each, are sent to all executors at most.
SENT = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ASCII_LOWER).split()


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; fewer words than a shingle form one, none form none."""
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    k = min(words, len(parts))
    first = [0, *ends[: len(parts) - k].tolist()]
    last = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes that vote on a lane; the first lane takes them as they are."""
    if not lane:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int) -> list[int]:
    """The lanes as signed 64-bit numbers; a bit is 1 if set in over half of the hashes."""
    total = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        for lane in range(lanes):
            bits = np.unpackbits(np.ascontiguousarray(lane_bits(part, lane), "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # eight bits stand in eight bytes of one number; 255 such numbers add up without a carry
            sums = np.add.reduceat(bits.view("<u8"), np.arange(0, len(part), 255), axis=0)
            total[lane] += sums.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<i8").ravel().tolist()


def lane_names(lanes: int) -> list[str]:
    return [f"f{i}" for i in range(lanes)]


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, d0, d1, f0, f1, ...) of every row; d0 and d1 are 128 bits that name the sequence of words."""
    names = ["d0", "d1", *lane_names(lanes)]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                parts = words_of(text.as_py())
                name = np.frombuffer(xxhash.xxh128_digest(b" ".join(parts), SEED), "<i8").tolist()
                rows.append([*name, *fingerprint(shingle_hashes(parts, words), lanes)])
            values = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(names)))], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in names)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def third_keys(names: list[str]) -> Column:
    """Each segment without each of its thirds as an array of ints: 22 bits of segment under the third's number."""
    out = []
    for lane, name in enumerate(names):
        for third, (start, width) in enumerate(THIRDS):
            low, high = CUTS[third // 3], CUTS[third // 3 + 1]
            mask = ((1 << (high - low)) - 1) & ~(((1 << width) - 1) << (start - low))
            part = F.shiftrightunsigned(F.col(name), low).bitwiseAND(F.lit(mask))
            out.append((part + F.lit((9 * lane + third) << 22)).cast("int"))
    return F.array(*out)


def variants(names: list[str], key: Column) -> Column:
    """The one-wildcard variants that travel under ``key``: key, number of the wildcard and the bits of the third."""
    third = F.shiftright(key, 22)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), third % 9 + 1)
    lane = F.element_at(F.array(*[F.col(n) for n in names]), F.floor(third / 9).cast("int") + 1)
    starts, widths = pick([a for a, _ in THIRDS]), pick([w for _, w in THIRDS])
    bits = F.call_function("shiftrightunsigned", lane, starts).bitwiseAND((F.call_function("shiftleft", F.lit(1).cast("long"), widths) - 1))
    one = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w)
    return F.transform(F.sequence(F.lit(0), widths - 1), lambda w: key.cast("long") * 4096 + w * 256 + bits.bitwiseAND(F.bitwise_not(one(w))))


def local_variants(key: np.ndarray, lanes: np.ndarray):
    """The same for the rows of a task: (rows, variants) for each number of the wildcard."""
    third = key >> 22
    start, width = (np.array([t[i] for t in THIRDS])[third % 9] for i in (0, 1))
    bits = (lanes[np.arange(len(key)), third // 9] >> start.astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)
    for w in range(8):
        rows = np.flatnonzero(width > w)
        yield rows, (key[rows] << 12) + (w << 8) + (bits[rows] & ~(1 << w))


def rest_variants(name: str, variant: Column) -> Column:
    """The one-wildcard variants of the bits outside the segment of ``variant``, each hashed with it."""
    segment, whole = F.floor(F.shiftright(variant, 34) / 3) % 3, F.col(name)
    low, high = (1 << CUTS[1]) - 1, (1 << CUTS[2]) - 1
    rest = (
        F.when(segment == 0, F.shiftrightunsigned(whole, CUTS[1]))
        .when(segment == 1, whole.bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(whole, CUTS[2]), CUTS[1])))
        .otherwise(whole.bitwiseAND(F.lit(high)))
    )
    out = []
    for start, end in zip(REST_CUTS, REST_CUTS[1:]):
        for at in range(start, end):
            part = rest.bitwiseAND(F.lit(((1 << end) - (1 << start)) & ~(1 << at)))
            out.append(F.xxhash64(variant, F.lit(at), part))
    return F.array(*out)


class Joined:
    """Which ids a task has joined; ``new`` keeps the edges that join two that were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def new(self, edges) -> list[tuple[int, int]]:
        out = []
        for a, b in edges:
            x, y = self.top(a), self.top(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, ids: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``prints`` (n x lanes); memory grows with n only."""
    edges, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _bits(prints[rest], prints[at]) <= max_bits
            if near.any():
                found = rest[near]
                edges += [(int(ids[at]), int(ids[j])) for j in found]
                queue += found.tolist()
                rest = rest[~near]
    return edges


def _links_of_runs(key: np.ndarray, ids: np.ndarray, prints: np.ndarray, max_bits: int, small: int = 6):
    """Edges within runs of equal keys: pairs by offset in small runs, forests in large ones."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(key)]]))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for gap in range(1, min(small, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[:-gap] == key[gap:]) & (size_of[:-gap] <= small))
        if len(i):
            i = i[_bits(prints[i], prints[i + gap]) <= max_bits]
            left.append(ids[i])
            right.append(ids[i + gap])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    more = [e for s, n in zip(starts[sizes > small], sizes[sizes > small]) for e in forest(prints[s : s + n], ids[s : s + n], max_bits)]
    return np.concatenate([a, [x for x, _ in more]]).astype(np.int64), np.concatenate([b, [y for _, y in more]]).astype(np.int64)


def _bucket_links(rows: DataFrame, n: int, max_bits: int, bucket: int, run_rows: int = 0) -> Staged:
    """Edges (a, b) within equal keys of (rep, lanes..., key); (null, key) names a key beyond the bound.

    With ``run_rows`` the key is that of a third, at most so many rows of it are held, and variants are made here.
    """
    rows = rows.repartition("key").sortWithinPartitions("key", "rep")
    most = run_rows or bucket

    def run(batches):
        key, ids, lanes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n), np.uint64)
        over, joined = None, Joined()
        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 2)]
            ids = np.concatenate([ids, more[0]])
            lanes = np.concatenate([lanes, np.stack([m.view(np.uint64) for m in more[1:-1]], axis=1)])
            key = np.concatenate([key, more[-1]])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield emit(key[:cut], ids[:cut], lanes[:cut], over, joined)
                key, ids, lanes = key[cut:], ids[cut:], lanes[cut:]
            if len(key) > most:  # the run goes on: it is split again, one row names its key
                over = int(key[0])
                key, ids, lanes = key[-1:], ids[-1:], lanes[-1:]
        if len(key):
            yield emit(key, ids, lanes, over, joined)

    def emit(key, ids, lanes, over, joined):
        large = set()
        if over is not None and over in (key[0], key[-1]):
            large.add(over)
        values, counts = np.unique(key, return_counts=True)
        large |= set(values[counts > most].tolist())
        if large:
            keep = ~np.isin(key, list(large))
            key, ids, lanes = key[keep], ids[keep], lanes[keep]
        edges = []
        for at, variant in local_variants(key, lanes) if run_rows else [(np.arange(len(key)), key)]:
            order = np.argsort(variant, kind="stable")
            at, variant = at[order], variant[order]
            if run_rows:
                values, counts = np.unique(variant, return_counts=True)
                if (counts > bucket).any():
                    large |= set((values[counts > bucket] >> 12).tolist())
                    keep = ~np.isin(variant >> 12, list(large))
                    at, variant = at[keep], variant[keep]
            a, b = _links_of_runs(variant, ids[at], lanes[at], max_bits)
            edges += joined.new(zip(a.tolist(), b.tolist()))
        marks = sorted(large)
        columns = [[*(e[0] for e in edges), *[None] * len(marks)], [*(e[1] for e in edges), *marks]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return Staged(rows.mapInArrow(run, "a long, b long"), "links")


def links(prints: DataFrame, names: list[str], max_bits: int, bucket: int = 8192, run: int = 1 << 18) -> DataFrame:
    """Edges (a, b) between ``rep`` ids that connect all linked fingerprints; ``prints`` is (rep, lanes...)."""
    if len(names) == 1 and max_bits > 5:
        raise ValueError("one lane finds all links up to five bits only")
    n = len(names)
    indexed = prints.where("rep is not null").select("rep", *names, F.explode(third_keys(names)).alias("key"))
    found = _bucket_links(indexed, n, max_bits, bucket, run)
    edges = [found.df.where("a is not null")]
    large = found.df.where("a is null").select(F.col("b").cast("int").alias("key")).distinct()
    if large.limit(1).count():
        rows = indexed.join(large, "key").select("rep", *names, F.explode(variants(names, F.col("key"))).alias("key"))
        rows = Staged(rows, "large-buckets").df
        found = _bucket_links(rows, n, max_bits, bucket)
        edges.append(found.df.where("a is not null"))
        large = found.df.where("a is null").select(F.col("b").alias("key")).distinct()
        rows = rows.join(large, "key")
        if n == 1:
            again = rows.select("rep", *names, F.col("key").alias("first"), F.explode(rest_variants(names[0], F.col("key"))).alias("key"))
            found = _bucket_links(again.drop("first"), 1, max_bits, bucket)
            edges.append(found.df.where("a is not null"))
            large = found.df.where("a is null").select(F.col("b").alias("key")).distinct()
            # those are alike throughout: each first bucket is searched once, however many second ones they share
            rows = again.join(large, "key").select("rep", *names, F.col("first").alias("key")).distinct()
        edges.append(_tiled(rows, names, max_bits, bucket))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def tiles(rows: DataFrame, chunks: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` once for each tile they take part in: (low, high) are the numbers of two chunks of their ``key``.

    ``chunks`` is (key, chunks): into how many the rows of each key are dealt by the hash of ``salt``.
    """
    rows = rows.join(chunks, key).withColumn("mine", F.pmod(F.xxhash64(salt), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("chunks", "mine", "other")


def _tiled(rows: DataFrame, names: list[str], max_bits: int, bucket: int) -> DataFrame:
    """The links inside buckets beyond the bound, searched in tiles of two chunks of about half a bucket."""
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, bucket // 2))).cast("int").alias("chunks"))

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        lanes = np.stack([group[n].to_numpy().view(np.uint64) for n in names], axis=1)
        return pd.DataFrame(forest(lanes, group["rep"].to_numpy(), max_bits), columns=["a", "b"]).astype("int64")

    dealt = tiles(rows, stage(counts, "chunks"), "key", "rep")
    return dealt.select("key", "low", "high", "rep", *names).groupBy("key", "low", "high").applyInPandas(tile, "a long, b long")


def near_groups(docs: DataFrame, words: int = 4, lanes: int = 1, max_bits: int = 4, bucket: int = 8192) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the id is the smallest doc_id reachable by links."""
    names = lane_names(lanes)
    rows = stage(fingerprints(docs, words, lanes).select("doc_id", *names), "fingerprints")
    # The least doc_id stands for all copies of a fingerprint. A doc_id with two texts ties its fingerprints.
    prints = stage(rows.groupBy(*names).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    edges = links(prints, names, max_bits, bucket)
    labels = stage(components(edges), "labels")
    own = prints.join(labels, prints["rep"] == labels["node"], "left").select(*names, F.coalesce("label", "rep").alias("component_id"))
    own = stage(own, "components")
    hexed = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return rows.join(own, names).select("doc_id", hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles."""
    return np.unique(shingle_hashes(words_of(text), words))


def overlap_forest(ids: np.ndarray, sets: list[np.ndarray], overlap: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets whose Jaccard overlap is ``overlap`` or more.

    The shingles of a text are flagged; one pass over the texts not yet reached then counts all intersections.
    """
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    flag = np.zeros(len(codes) + 1, np.int32)
    edges, rest = [], np.arange(len(sets))
    flat, begin = codes, ends - sizes
    at_rest = np.ones(len(sets), bool)  # of the texts in ``flat``, those not yet reached
    queue: list[int] = []
    while at_rest.any():
        if 2 * at_rest.sum() < len(rest):  # leave out those that are done
            keep = np.repeat(at_rest, sizes[rest])
            flat, rest = flat[keep], rest[at_rest]
            begin, at_rest = np.cumsum(sizes[rest]) - sizes[rest], np.ones(len(rest), bool)
        if not queue:
            first = int(np.argmax(at_rest))
            at_rest[first] = False
            queue = [int(rest[first])]
            if not at_rest.any():
                break
        at = queue.pop()
        own = codes[ends[at] - sizes[at] : ends[at]]
        flag[own] = 1
        common = np.add.reduceat(flag[flat], begin)
        flag[own] = 0
        near = np.flatnonzero(at_rest & (common >= overlap * (sizes[rest] + sizes[at] - common) - 1e-9))
        edges += [(int(ids[at]), int(ids[j])) for j in rest[near]]
        queue += rest[near].tolist()
        at_rest[near] = False
    return edges


def overlap_links(docs: DataFrame, groups: DataFrame, words: int, overlap: float, chunk_texts: int, chunk_bytes: int) -> DataFrame:
    """Edges (a, b) that connect all texts of ``groups`` (node, label) that overlap, each group compared in full.

    A chunk has about ``chunk_texts`` texts and ``chunk_bytes`` of shingle hashes, so a task holds two such and
    what one text has beyond.
    """

    def describe(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            whole = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], whole], ["label", "id", "shingles"]).filter(pa.array([len(s) > 0 for s in sets]))

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(groups, F.col("id") == F.col("node"))
    sets = texts.select("label", "id", "text").mapInArrow(describe, "label long, id long, shingles binary")
    sets = stage(sets.dropDuplicates(["label", "id", "shingles"]), "shingle-sets")
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(chunk_texts), F.sum(F.octet_length("shingles")) / F.lit(chunk_bytes))).cast("int")
    dealt = tiles(sets, stage(sets.groupBy("label").agg(chunks.alias("chunks")), "chunks"), "label", "id")
    dealt = dealt.select("label", "low", "high", "id", "shingles").repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "id")

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and now != tuple(keys[a]):
                    yield close(held)
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield close(held)

    def close(parts):
        ids = np.concatenate([p.column(3).to_numpy() for p in parts])
        sets = [np.frombuffer(x.as_py(), np.uint64) for p in parts for x in p.column(4)]
        edges = overlap_forest(ids, sets, overlap)
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copies(
    docs: DataFrame, words: int = 5, overlap: float = 0.8, print_words: int = 2, lanes: int = 4, max_bits: int = 51,
    bucket: int = 8192, chunk_texts: int = 1024, chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """(doc_id, component_id) of every row; the id is the smallest doc_id reachable by links of ``overlap`` or more.

    Candidates are fingerprints of ``lanes`` lanes that differ in ``max_bits`` bits or fewer.
    """
    names = lane_names(lanes)
    rows = stage(fingerprints(docs, print_words, lanes), "fingerprints")
    prints = stage(rows.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), *[F.any_value(n).alias(n) for n in names]), "distinct-texts")
    with_groups = stage(components(links(prints.select("rep", *names), names, max_bits, bucket)), "candidate-groups")
    edges = overlap_links(docs, with_groups, words, overlap, chunk_texts, chunk_bytes)
    labels = stage(components(edges), "labels")
    own = prints.join(labels, prints["rep"] == labels["node"], "left").select("d0", "d1", F.coalesce("label", "rep").alias("component_id"))
    return rows.select("doc_id", "d0", "d1").join(stage(own, "components"), ["d0", "d1"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, overlap: float = 0.8, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near copies, with their own columns.

    Of rows that repeat a doc_id one stays; rows without doc_id stay.
    """
    ids = near_copies(docs, words, overlap, **how).where("doc_id is not null")
    ids = stage(ids.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")), "near-ids")
    gone = stage(ids.where("doc_id <> c").select(F.col("doc_id").alias("__tm_id")), "near-gone")
    if gone.count() <= SENT:  # texts stay where they are; beyond, both sides are shuffled
        gone = F.broadcast(gone)
    out = docs.join(gone, F.col("doc_id") == F.col("__tm_id"), "left_anti")
    again = ids.where("doc_id = c and n > 1").select(F.col("doc_id").alias("__tm_id"))
    if again.limit(1).count():
        once = out.join(again, F.col("doc_id") == F.col("__tm_id"), "left_anti")
        many = out.join(again, F.col("doc_id") == F.col("__tm_id"), "left_semi")
        first = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct("text")).alias("__tm_row")
        out = once.unionByName(many.groupBy(F.col("doc_id").alias("__tm_id")).agg(first).select("__tm_row.*"))
    return out
