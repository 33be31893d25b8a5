"""Language-model scores by prediction by partial matching over a distributed byte trie.

A text is its bytes, A-Z lower-cased, and one end mark; each is predicted from up to ``order`` bytes before it.
The model has, for every context seen in training, the counts of what followed. If the symbol followed the
longest context, it costs its share there (escape method C: a context that was followed by q different symbols
n times gives n/(n+q) to them and q/(n+q) to all others). Else the escape is paid and the next shorter context
is asked, without the symbols that the longer one has ruled out. Below the empty context the remaining symbols
are equally likely. What a context excludes from its parent depends on the context alone, so the excluded count
is a sum that the trie keeps per node.

The base is a unigram model of words with add-half smoothing.

Scale: the trie is never gathered anywhere. Documents are dealt by a hash of doc_id and text - repeated rows by
their number, too - into groups of about ``group_bytes`` of text. A group reports its distinct grams (context and symbol) and words with their training counts; the counts
are added up over all groups, the code length of every distinct gram follows from joins between levels of the
trie, and each group gets back the code lengths of its own grams and words to add up its texts. So memory
follows the group, shuffles follow the input, and the model grows with the corpus.

Defined cases: null text is empty: its only token and symbol is the end; a text without doc_id is scored but
not learned from; rows that repeat a doc_id are learned from each; without training text all symbols are
equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged

#: Pads the start of a text and marks its end; it is no byte of UTF-8.
END = 0xFF
CHUNK = 1 << 20
#: Rows that are the same in doc_id and text are dealt one by one if any is there more often.
MANY = 1000
#: The end mark among words; a word has no blanks.
END_WORD = " "


def grams(texts: list[bytes], order: int):
    """Chunks of codes: ``order`` bytes of context and the symbol in the lowest byte."""
    pad = bytes([END]) * order
    buffer: list[bytes] = []
    size = 0

    def codes():
        b = np.frombuffer(pad + b"".join(t + pad for t in buffer), np.uint8)
        ends = np.cumsum([len(t) + order for t in buffer])
        for low in range(0, len(b) - order, CHUNK):
            part = b[low : low + CHUNK + order]
            code = np.zeros(len(part) - order, np.int64)
            for j in range(order + 1):
                code = (code << 8) | part[j : len(part) - order + j]
            keep = np.ones(len(code), bool)  # of the pad after a text only the first is a symbol
            for j in range(1, order):
                at = ends - j - low
                keep[at[(at >= 0) & (at < len(code))]] = False
            yield code[keep]

    for t in texts:
        buffer.append(t)
        size += len(t)
        if size >= CHUNK:
            yield from codes()
            buffer, size = [], 0
    if buffer:
        yield from codes()


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and their counts."""
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in grams(texts, order):
        part.sort()
        first = np.flatnonzero(np.diff(part, prepend=part[0] - 1 if len(part) else 0))
        both = np.concatenate([code, part[first]])
        more = np.concatenate([count, np.diff(np.append(first, len(part)))])
        by = np.argsort(both, kind="stable")
        both, more = both[by], more[by]
        first = np.flatnonzero(np.diff(both, prepend=both[0] - 1 if len(both) else 0))
        code, count = both[first], np.add.reduceat(more, first) if len(first) else more
    return code, count


class Prices:
    """Prices of codes by hash: one probe for most, a binary search for those that share a slot."""

    def __init__(self, code: np.ndarray, price: np.ndarray):
        bits = max(8, int(len(code) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.code, self.price = np.append(code, -1), np.append(price, 0.0)
        here, mine = self._hash(code), np.arange(len(code), dtype=np.int32)
        self.slot = np.full(1 << bits, len(code), np.int32)
        self.slot[here] = mine
        lost = np.flatnonzero(self.slot[here] != mine)
        lost = lost[np.argsort(code[lost])]
        self.more, self.more_price = code[lost], price[lost]

    def _hash(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(code)]
        out, missed = self.price[at], np.flatnonzero(self.code[at] != code)
        if len(missed):
            out[missed] = self.more_price[np.searchsorted(self.more, code[missed])]
        return out


def lowered(texts: pa.ChunkedArray) -> pa.Array:
    """Texts with A-Z lower-cased, null as empty."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    return low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low


def words_of(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, split at ASCII white space, and the text that each is from."""
    parts = pc.ascii_split_whitespace(low)
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), pc.list_parent_indices(parts).filter(some).to_numpy()


def raw(low: pa.Array) -> list[bytes]:
    return low.cast(pa.binary()).to_pylist()


def score_documents(docs: DataFrame, order: int = 4, folds: int = 5, held_fold: int = 1, group_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Texts whose crc32(doc_id as text) modulo ``folds`` is ``held_fold`` are held out.
    """
    if not 1 <= order <= 6:
        raise ValueError("a gram must fit a 64-bit number: order 1 to 6")
    rows = docs.select("doc_id", "text")
    per_row = rows.groupBy(F.xxhash64("doc_id", "text").alias("h")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, total = per_row.agg(F.max("n"), F.sum("bytes")).first()
    groups = max(1, -(-int(total or 0) // group_bytes), min(8, int(total or 0) >> 19))
    rows = rows.withColumn("copy", F.lit(1).cast("long"))
    if (most or 0) > MANY:  # number the repeated rows, so that they are dealt to all groups
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(True))
    dealt = rows.select(
        F.pmod(F.xxhash64("doc_id", "text", "copy"), F.lit(groups)).cast("int").alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held.alias("held_out"),
        "text",
    )

    def collect(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        low = lowered(table.column("text"))
        held_out = table.column("held_out").to_numpy().astype(bool)
        own, other = (low.filter(pa.array(m)) for m in (~held_out, held_out))
        found = pc.value_counts(words_of(own)[0])
        word, times = found.field("values"), found.field("counts")
        seen = pc.unique(words_of(other)[0])
        seen = seen.filter(pc.invert(pc.is_in(seen, value_set=word)))
        code, count = gram_counts(raw(own), order)
        new = np.setdiff1d(gram_counts(raw(other), order)[0], code, assume_unique=True)
        word = pa.concat_arrays([word, seen, pa.array([END_WORD])])
        n = np.concatenate([times.to_numpy(), np.zeros(len(seen), np.int64), [len(own)], count, np.zeros(len(new), np.int64)])
        return pa.table(
            {
                "g": pa.array(np.full(len(n), g, np.int32)),
                "gram": pa.concat_arrays([pa.nulls(len(word), pa.int64()), pa.array(np.concatenate([code, new]))]),
                "word": pa.concat_arrays([word, pa.nulls(len(code) + len(new), pa.string())]),
                "n": pa.array(n, pa.int64()),
            }
        )

    counts = dealt.groupBy("g").applyInArrow(collect, "g int, gram long, word string, n long")
    counts = Staged(counts.withColumn("is_word", F.col("gram").isNull()), "gram-counts", ["is_word"])
    words = Staged(counts.df.where("is_word").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, kinds = words.df.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = int(tokens or 0), int(kinds or 0)
    cost = code_lengths(counts.df.where("not is_word").groupBy("gram").agg(F.sum("n").alias("n")), order)

    wanted = counts.df.where("is_word").select("g", "word").join(words.df, "word").select("g", F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("v"))
    priced = counts.df.where("not is_word").select("g", "gram").join(cost.df, "gram").select("g", "gram", F.lit(None).cast("string").alias("word"), F.col("cost").alias("v"))
    back = wanted.unionByName(priced)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = pc.is_null(right.column("gram"))
        told = right.filter(is_word)
        bottom = np.log10(tokens + 0.5 * (kinds + 1))
        logs_of = np.log10(told.column("v").to_numpy() + 0.5) - bottom
        unseen = np.log10(0.75) - bottom  # between a word never counted and one counted once
        rest = right.filter(pc.invert(is_word))
        price = Prices(rest.column("gram").to_numpy(), rest.column("v").to_numpy())
        low = lowered(left.column("text"))
        n, end = len(low), logs_of[told.column("word").index(END_WORD).as_py()]
        words, at = words_of(low)
        logs = logs_of[pc.index_in(words, value_set=told.column("word").combine_chunks()).to_numpy()]
        total = lambda w: np.bincount(at, w, n)
        n_tokens, n_known = total(None) + 1, total(logs > unseen).astype(np.int64) + int(end > unseen)
        bits = [sum(float(price.of(part).sum()) for part in grams([t], order)) for t in raw(low)]
        columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(total(logs) + end), pa.array(bits, pa.float64())]
        return pa.table(
            [left.column("doc_id"), left.column("held_out"), columns[0], columns[1], pa.array([tokens] * n, pa.int64()), columns[2], columns[3]],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(add_up, schema)


def code_lengths(counts: DataFrame, order: int) -> Staged:
    """(gram, cost), staged: the log10 probability of each gram's symbol after its context, from (gram, n).

    Grams seen in training need their own context only. The others - a small part - go down the levels of the
    trie: at each, a join tells what followed the context, another whether the symbol did.
    """
    all_grams = Staged(counts, "grams")
    levels = [Staged(all_grams.df.where("n > 0").select("gram", F.col("n").alias("c")), f"level{order}")]
    for j in range(order - 1, -1, -1):
        mask = (1 << 8 * (j + 1)) - 1
        shorter = levels[0].df.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("c").alias("c"))
        levels.insert(0, Staged(shorter, f"level{j}"))

    def contexts(j: int) -> DataFrame:
        """(ctx, t, q, x): total and number of symbols after a context, and their total after its parent."""
        here = levels[j].df.withColumn("ctx", F.shiftright("gram", 8))
        if not j:
            return here.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("q"), F.lit(0).cast("long").alias("x"))
        up = levels[j - 1].df.select(F.col("gram").alias("up"), F.col("c").alias("up_c"))
        here = here.join(up, F.col("gram").bitwiseAND(F.lit((1 << 8 * j) - 1)) == F.col("up"))
        return here.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("q"), F.sum("up_c").alias("x"))

    nodes = [Staged(contexts(j), f"contexts{j}") for j in range(order + 1)]
    seen = all_grams.df.where("n > 0").withColumn("ctx", F.shiftright("gram", 8)).join(nodes[order].df, "ctx")
    seen = seen.select("gram", F.log10(F.col("n") / (F.col("t") + F.col("q"))).alias("cost"))

    # cost: paid so far; ex_t, ex_q: what the longer context rules out; open: the symbol is still not found
    rest = all_grams.df.where("n = 0").select(
        "gram", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("ex_t"), F.lit(0).cast("long").alias("ex_q"), F.lit(True).alias("open")
    )
    for j in range(order, -1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        node = nodes[j].df.select(F.col("ctx").alias("__ctx"), "t", "q", "x")
        leaf = levels[j].df.select(F.col("gram").alias("__gram"), "c")
        if j <= 1:  # at most 256 contexts and 65,536 grams
            node, leaf = F.broadcast(node), F.broadcast(leaf)
        rest = rest.join(node, F.shiftright(suffix, 8) == F.col("__ctx"), "left").join(leaf, suffix == F.col("__gram"), "left")
        total, other = F.col("t") - F.col("ex_t"), F.col("q") - F.col("ex_q")
        share = F.when(F.col("c").isNotNull(), F.col("c")).otherwise(other) / (total + other)
        asked = F.col("open") & F.col("t").isNotNull() & (total + other > 0)
        rest = rest.select(
            "gram",
            (F.col("cost") + F.when(asked, F.log10(F.when(asked, share))).otherwise(F.lit(0.0))).alias("cost"),
            F.when(F.col("t").isNotNull(), F.col("x")).otherwise(F.col("ex_t")).alias("ex_t"),
            F.when(F.col("t").isNotNull(), F.col("q")).otherwise(F.col("ex_q")).alias("ex_q"),
            (F.col("open") & ~(asked & F.col("c").isNotNull())).alias("open"),
        )
    bottom = F.when(F.col("open"), -F.log10(F.lit(256.0) - F.col("ex_q"))).otherwise(F.lit(0.0))
    out = Staged(seen.unionByName(rest.select("gram", (F.col("cost") + bottom).alias("cost"))), "code-lengths")
    for table in (all_grams, *levels, *nodes):
        table.drop()
    return out

