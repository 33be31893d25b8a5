"""Benchmark decontamination with suffix arrays over the documents.

Words are runs of ASCII letters and digits and of any non-ASCII character, A-Z lower-cased. A *window* is ten
consecutive words of a benchmark item (all of an item that has fewer). Documents are taken in shards of about a
million words: words become numbers (zero for words that no item uses), the whole suffixes within stretches of
item words long enough for some window are sorted - the shard's suffix array - and every item suffix is
binary-searched in it by its first ten words. Every find that cannot be made longer to the left is followed to its
end: these are the longest verbatim matches, with their places in document and item.

Scale: documents are read once and never shuffled; a shard's size bounds the memory whatever the partition. The
benchmark travels to the executors in pieces of at most ``piece_bytes``, one broadcast and one pass over the
documents for each, so what is broadcast is bounded too; one piece is the rule, and more leave hashes and matches.

Defined cases: null text has no words and is never hit; null items and items without words match nothing;
items with equal windows are all reported; repeated rows are judged alike; an empty benchmark leaves all
documents clean; columns named as ours are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ALNUM_LOWER, set_aside, stage, with_columns_last

#: A shard is closed at so many words; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
ADDED = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM_LOWER).split()


def suffix_order(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of their whole suffixes, each up to the next 0, by prefix doubling.

    ``at`` holds every place of the stretches that it touches.
    """
    rank = np.zeros(len(words) + 1, np.int64)
    rank[at] = words[at]
    step, order = 1, np.argsort(rank[at], kind="stable")
    while len(at):
        there = np.minimum(at + step, len(words))
        key = rank[at] * (rank.max() + 1) + np.where(rank[at] > 0, rank[there], 0)
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        settled = new[-1] == len(at) or new[-1] == rank.max() and step > 1
        rank[at[order]] = new
        if settled or step > len(words):
            break
        step *= 2
    return at[order]


class Tests:
    """The item suffixes of one piece of the benchmark, ready to be searched."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.words: list[tuple[str, np.ndarray]] = []
        at: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            n = min(window, len(ids))
            key = ids.astype(">u4").tobytes()
            for i in range(len(ids) - n + 1 if n else 0):
                at.setdefault(n, {}).setdefault(key[4 * i : 4 * (i + n)], []).append((len(self.words), i))
            self.words.append((item, ids))
        self.lengths = sorted(at)
        #: By window length: the sorted suffixes as far as they are searched, and the (item, offset) of each.
        self.suffixes = {n: np.array(sorted(k), f"S{4 * n}") for n, k in at.items()}
        self.places = {n: [at[n][k] for k in sorted(at[n])] for n in at}

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[str, int, int, int]]]:
        """What a shard's words have of the items: the words inside windows, and the longest verbatim matches.

        A match is (item, start in the shard, length, start in the item); it cannot be made longer on either side.
        """
        hit = np.zeros(len(ids) + 1, np.int32)
        if not self.lengths:
            return hit[:-1] > 0, []
        ends = np.flatnonzero(np.append(ids, 0) == 0)
        stretch = np.searchsorted(ends, np.arange(len(ids)))
        room = ends[stretch] - np.arange(len(ids))
        first = np.append(-1, ends)[stretch] + 1
        at = np.flatnonzero((ids > 0) & (ends[stretch] - first >= self.lengths[0]))
        where = suffix_order(ids, at)
        deep = self.lengths[-1]
        padded = np.concatenate([ids, np.zeros(deep, ids.dtype)])
        look = padded[where[:, None] + np.arange(deep)]
        look[np.arange(deep) >= room[where][:, None]] = 0
        look = look.astype(">u4")
        before = np.concatenate([[0], ids])
        matches = []
        for n in self.lengths:
            cut = np.ascontiguousarray(look[:, :n]).view(f"S{4 * n}").ravel()
            low = np.searchsorted(cut, self.suffixes[n], "left")
            high = np.searchsorted(cut, self.suffixes[n], "right")
            for k in np.flatnonzero(high > low):
                found = where[low[k] : high[k]]
                found = found[room[found] >= n]
                np.add.at(hit, found, 1)
                np.add.at(hit, found + n, -1)
                for item, i in self.places[n][k]:
                    name, words = self.words[item]
                    for p in found[before[found] != words[i - 1]] if i else found:
                        most = min(len(words) - i, int(room[p]))
                        differ = np.flatnonzero(ids[p : p + most] != words[i : i + most])
                        matches.append((name, int(p), int(differ[0]) if len(differ) else most, i))
        return np.cumsum(hit[:-1]) > 0, matches


class Known(dict):
    """Numbers of item words; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def judge(tests: Tests, shard: list[np.ndarray]) -> list[list[dict]]:
    """The longest verbatim matches in each document of a shard, by place."""
    gap = np.zeros(1, np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in shard])])
    spans: list[list[dict]] = [[] for _ in shard]
    _, matches = tests.search(np.concatenate([x for w in shard for x in (w, gap)]))
    for item, p, n, i in matches:
        d = int(np.searchsorted(bounds, p, "right")) - 1
        start = p - int(bounds[d])
        spans[d].append({"item_id": item, "start_word": start, "end_word": start + n, "item_word": i})
    return spans


def added(n_words: int, spans: list[dict]) -> tuple:
    """The added columns. Each word of a match is inside some window, and each window inside some match."""
    spans = sorted(spans, key=lambda s: (s["start_word"], s["end_word"], s["item_id"], s["item_word"]))
    covered, end = 0, 0
    for s in spans:
        covered += max(0, s["end_word"] - max(s["start_word"], end))
        end = max(end, s["end_word"])
    items = sorted({s["item_id"] for s in spans})
    return n_words, covered, len(items), items, spans, covered > 0


FIELDS = {"item_id": "string", "start_word": "long", "end_word": "long", "item_word": "long"}
SPAN = T.ArrayType(T.StructType([T.StructField(k, T.StringType() if v == "string" else T.LongType()) for k, v in FIELDS.items()]))
SPAN_ARROW = pa.list_(pa.struct([(k, pa.string() if v == "string" else pa.int64()) for k, v in FIELDS.items()]))


def matched(piece, window: int, texts) -> list[tuple[int, list[dict]]]:
    """(number of words, matches) of each text, shard by shard."""
    tests = piece if isinstance(piece, Tests) else Tests(piece, window)
    known = Known(tests.vocabulary).__getitem__
    sizes: list[int] = []
    spans: list[list[dict]] = []
    shard: list[np.ndarray] = []
    size = 0
    for d, text in enumerate(texts):
        words = words_of(text.as_py())
        shard.append(np.fromiter(map(known, words), np.int32, len(words)))
        sizes.append(len(words))
        size += len(words)
        if d + 1 == len(texts) or size >= SHARD_WORDS:
            spans += judge(tests, shard)
            shard, size = [], 0
    return list(zip(sizes, spans))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, piece_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted), spans (longest matches) and contaminated.

    A benchmark beyond one piece takes a pass over the texts for each other piece first, which leaves the matches
    by a 128-bit hash of the text; matches depend on the text alone.
    """
    spark, rest = docs.sparkSession, with_columns_last(docs, ADDED)
    pieces = [spark.sparkContext.broadcast(piece) for piece in _pieces(benchmark, piece_bytes)] or [spark.sparkContext.broadcast([])]
    hashes = [F.xxhash64("text").alias("__tm_h0"), F.xxhash64(F.lit(window), F.col("text")).alias("__tm_h1")]
    more = [_matches_of(docs.select(*hashes, "text"), piece, window) for piece in pieces[1:]]
    base = docs.select(*rest, *hashes)
    if more:
        every = more[0]
        for one in more[1:]:
            every = every.unionByName(one)
        every = every.groupBy("__tm_h0", "__tm_h1").agg(F.flatten(F.collect_list("found")).alias("__tm_found"))
        base = base.join(stage(every, "matches"), ["__tm_h0", "__tm_h1"], "left").select(*rest, "__tm_found")
    else:
        base = base.select(*rest, F.lit(None).cast(SPAN).alias("__tm_found"))
    schema = T.StructType(list(base.schema.fields[:-1]))
    for name, kind in zip(ADDED, ("long", "long", "long", T.ArrayType(T.StringType()), SPAN, "boolean")):
        schema = schema.add(name, kind)
    first, at = pieces[0], rest.index("text")

    def run(batches):
        tests = Tests(first.value, window)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), SPAN_ARROW, pa.bool_())
        for batch in batches:
            found = matched(tests, window, batch.column(at))
            rows = [added(n, spans + (others.as_py() or [])) for (n, spans), others in zip(found, batch.column(len(rest)))]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, *ADDED])

    return base.mapInArrow(run, schema)


def _matches_of(texts: DataFrame, piece, window: int) -> DataFrame:
    """(__tm_h0, __tm_h1, found) of the texts that match the piece, each text once; staged."""

    def run(batches):
        tests = Tests(piece.value, window)
        for batch in batches:
            found = [spans for _, spans in matched(tests, window, batch.column(2))]
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, SPAN_ARROW)], ["__tm_h0", "__tm_h1", "found"])
            yield out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    schema = T.StructType(list(texts.schema.fields[:2])).add("found", SPAN)
    every = texts.mapInArrow(run, schema)
    return stage(every.groupBy("__tm_h0", "__tm_h1").agg(F.any_value("found").alias("found")), "piece-matches")


def _pieces(benchmark: DataFrame, piece_bytes: int):
    """The items in pieces of bounded size; the driver holds one at a time."""
    items, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if items and size + len(row[1]) > piece_bytes:
            yield items
            items, size = [], 0
        items.append((row[0], row[1]))
        size += len(row[1])
    if items:
        yield items


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without an occurrence of any window, with their own columns."""
    base, back = set_aside(docs, ADDED)
    return back(find_matches(base, benchmark, window).where("not contaminated"))
