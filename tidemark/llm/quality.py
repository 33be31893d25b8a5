"""Quality classifier learned from positives and unlabelled text (non-negative PU learning).

Each text becomes a short vector of statistics of form: shares of marks, digits, capitals and separators, word
lengths, repetition of words and lines, function words, and hashed shares of character kinds at word ends.
Trusted positives are training rows labelled 1; the unlabelled sample is drawn from all training rows whatever
their label. A one-hidden-layer network minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the class prior estimated from positives and unlabelled rows (``separate``). No row labelled 0 takes part.
The score is the network's probability; ``platt`` is an option that fits a rising line through the logit to labels
of both kinds.

Scale: one pass over the texts turns each row into 40 numbers, which are staged; everything else reads these. Mean
and scale are sums over all training rows. The fit runs on the driver over about ``sample`` positives and unlabelled
rows each, the ones with the least hash of doc_id: their number bounds what is sorted, broadcast and collected, some
MB at the default. More rows have not been tried; rare kinds of text are in the sample in
their proportion.

Defined cases: null and empty texts are scored like any other, from an all-zero vector; rows that repeat a
doc_id are scored each, and the least of their vectors teaches; labels of unknown documents or without a value
teach nothing; a doc_id labelled both ways counts as its larger label; without training positives every score is
that of an untaught network; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from tidemark.llm.common import Staged, stage, with_columns_last

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is it that was for on are as with be or der die und das ist den im zu von mit ein eine nicht auf "
    "als auch für le la les de des et en un une du que qui dans pour est pas sur el los las y por con para se su".split()
)
MARK = re.compile(r"[^\w\s]")
ENDS = 16
#: How many numbers describe a text.
WIDTH = 24 + ENDS


def describe(text: str | None) -> list[float]:
    """The statistics of one text; all are shares or bounded logarithms, so no length dominates."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * WIDTH
    n, chars = len(words), len(text)
    marks = Counter(MARK.findall(text))
    total_marks = sum(marks.values())
    counts = Counter(words)
    lower = text.lower().split()
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    title = sum(w[0].isupper() for w in words)
    digits = sum(map(str.isdigit, text))
    letters = sum(map(str.isalpha, text))
    ends = Counter(w[-1] for w in words)
    out = [
        min(np.log1p(n) / 10, 1.5),
        min(chars / n / 20, 3.0),
        total_marks / n,
        (marks["."] + marks[","]) / n,
        marks["!"] / n,
        marks["|"] / n,
        (total_marks - sum(marks[c] for c in ".,!|?;:-'\"")) / n,
        digits / chars,
        letters / chars,
        upper / n,
        title / n,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        max(pairs.values()) / (n - 1) if n > 1 else 0.0,
        len(pairs) / (n - 1) if n > 1 else 1.0,
        sum(w.strip(".,;:!?") in FUNCTION_WORDS for w in lower) / n,
        len(set(lines)) / len(lines),
        min(np.log1p(n / len(lines)) / 6, 1.5),
        sum(not any(map(str.isalnum, w)) for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
        sum(len(w) > 14 for w in words) / n,
        float(n < 5),
        float(n < 20),
    ]
    tail = [0.0] * ENDS
    for c, k in ends.items():
        if not c.isalpha():
            tail[ord(c) % ENDS] += k / n
    return [float(x) for x in out] + tail


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows without an id fall into fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1)).cast("int")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Standardised inputs, one hidden layer of tanh, one logit, and a line that calibrates the logit."""

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.parts = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.slope, self.shift = 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logit(x) + self.shift)

    def calibrate(self, x: np.ndarray, good: np.ndarray) -> None:
        """Fit the line by Newton steps to smoothed targets (Platt scaling); one-sided labels leave it."""
        n1, n0 = good.sum(), (~good).sum()
        if not n1 or not n0:
            return
        target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        z = np.column_stack([self.logit(x), np.ones(len(x))])
        line = np.array([1.0, 0.0])
        for _ in range(100):
            s = sigmoid(z @ line)
            slope = z.T @ (s - target) + 1e-3 * (line - [1.0, 0.0])
            bend = (z * (s * (1 - s))[:, None]).T @ z + 1e-3 * np.eye(2)
            line = line - np.clip(np.linalg.solve(bend, slope), -1, 1)
        if line[0] > 0:
            self.slope, self.shift = line

    def settle(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        """Fit the line to the unbiased PU risk, which is convex in it for the logistic loss; no negative is needed.

        At its least the scores of the unlabelled rows add up to the prior; ``pull`` keeps the line from a step.
        """
        if not len(positive) or not len(unlabelled):
            return
        u, p = (np.column_stack([self.logit(x), np.ones(len(x))]) for x in (unlabelled, positive))
        line, pull = np.array([1.0, 0.0]), 1e-2
        for _ in range(200):
            s = sigmoid(u @ line)
            slope = u.T @ s / len(u) - prior * p.mean(0) + pull * (line - [1.0, 0.0])
            bend = (u * (s * (1 - s))[:, None]).T @ u / len(u) + pull * np.eye(2)
            line = line - np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
        if 0 < line[0] < 20:
            self.slope, self.shift = line

    def slopes(self, x: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        """Gradients of sum(by * logit) by the parts; ``x`` is standardised."""
        w, b, v, _ = self.parts
        h = np.tanh(x @ w + b)
        back = by[:, None] * v * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ by, np.array([by.sum()])]


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None, hidden: int = 24, epochs: int = 150, seed: int = 0
) -> Network:
    """Minimise the non-negative PU risk with the logistic loss by Adam over mini-batches."""
    net = Network(unlabelled.shape[1], hidden, seed)
    if not len(positive) or not len(unlabelled):
        return net
    net.mean = unlabelled.mean(0) if mean is None else mean
    net.scale = np.maximum(unlabelled.std(0), 1e-3) if scale is None else scale
    p, u = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled))
    rng, step, size = np.random.default_rng(seed + 1), 0, 256
    first, second = [np.zeros_like(x) for x in net.parts], [np.zeros_like(x) for x in net.parts]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for at in np.array_split(rng.permutation(len(u)), max(1, len(u) // size)):
            xu, xp = u[at], p[rng.integers(0, len(p), min(size, len(p)))]
            zu, zp = (np.tanh(x @ net.parts[0] + net.parts[1]) @ net.parts[2] + net.parts[3][0] for x in (xu, xp))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                by_u, by_p = sigmoid(zu) / len(zu), prior * (sigmoid(zp) - 1 - sigmoid(zp)) / len(zp)
            else:
                by_u, by_p = -sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp)
            grads = [a + b for a, b in zip(net.slopes(xu, by_u), net.slopes(xp, by_p))]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * net.parts[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.parts[i] = net.parts[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def separate(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> float:
    """The class prior from positives and unlabelled texts alone (best-bin estimation).

    A network fitted to half of both ranks the other half. Above any bar, the share of unlabelled texts over the
    share of positives is at least the prior but for chance, and near it where only positives score: the bar with
    the least ratio, each share allowed its confidence bound, gives the estimate.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    rng = np.random.default_rng(seed + 2)
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    net = fit(p[::2], u[::2], 0.5, mean, scale, epochs=60, seed=seed)
    zp, zu = np.sort(net.logit(p[1::2])), np.sort(net.logit(u[1::2]))
    above_p = 1 - np.arange(len(zp)) / len(zp)
    above_u = 1 - np.searchsorted(zu, zp, "left") / len(zu)
    slack = lambda n: np.sqrt(np.log(4 / 0.1) / (2 * n))
    bound = (above_u + slack(len(zu)) + slack(len(zp))) / above_p
    best = int(np.argmin(np.where(above_p > 2 * slack(len(zp)), bound, np.inf)))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def described(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row and __tm_x, the statistics of its text."""
    base = docs.select(*columns, F.col("text").alias("__tm_text"))
    schema = StructType(list(base.schema.fields[:-1])).add("__tm_x", ArrayType(FloatType()))

    def run(batches):
        for batch in batches:
            x = pa.array([describe(t.as_py()) for t in batch.column(len(columns))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*columns, "__tm_x"])

    return base.mapInArrow(run, schema)


def learn(rows: DataFrame, labels: DataFrame, held_fold: int = 0, sample: int = 20000, platt: bool = False) -> Network:
    """The network, from ``rows`` (doc_id, __tm_x) outside ``held_fold``.

    Mean and scale of the inputs are those of all training rows. With ``platt`` a line through the logit, fitted
    to labels of both kinds, turns it into the score; the line rises, so the order of scores stays.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__tm_id")).agg(F.max("quality").alias("__tm_q"))
    rows = rows.select(F.col("doc_id").alias("__tm_id"), "__tm_x").where(F.col("__tm_id").isNotNull() & (fold(F.col("__tm_id")) != held_fold))
    at = lambda i: F.element_at("__tm_x", i + 1).cast("double")
    sums = rows.agg(F.count("*"), *[F.sum(at(i)) for i in range(WIDTH)], *[F.sum(at(i) * at(i)) for i in range(WIDTH)]).first()
    n = max(1, sums[0])
    mean, square = (np.array([sums[1 + k * WIDTH + i] or 0.0 for i in range(WIDTH)]) / n for k in (0, 1))
    scale = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0.0)), 1e-3)
    ids = rows.select("__tm_id").distinct()
    known = Staged(ids.join(own, "__tm_id"), "labelled")
    counts = [known.df.where("__tm_q = 1").count(), sums[0], known.df.count()]

    def least(df: DataFrame, role: int, label: str, of: int) -> DataFrame:
        """About ``sample`` rows of least hash: the bar on the hash leaves little more than that to be sorted."""
        share = min(1.0, (1.2 * sample + 1000) / max(1, of))
        hashed = F.xxhash64("__tm_id")
        first = df.where(hashed <= F.lit(int((share - 0.5) * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(hashed, "__tm_id").limit(sample)
        return first.select("__tm_id", F.expr(label).cast("int").alias("__tm_q"), F.lit(role).alias("__tm_role"))

    chosen = least(known.df.where("__tm_q = 1"), 0, "1", counts[0]).unionByName(least(ids, 1, "null", counts[1]))
    if platt:
        chosen = chosen.unionByName(least(known.df, 2, "__tm_q", counts[2]))
    chosen = Staged(chosen, "chosen")
    taken = rows.join(F.broadcast(chosen.df), "__tm_id").groupBy("__tm_id", "__tm_q", "__tm_role").agg(F.min("__tm_x").alias("x")).select("x", "__tm_q", "__tm_role").collect()
    x, role = np.array([r[0] for r in taken], np.float64).reshape(-1, WIDTH), np.array([r[2] for r in taken], int)
    order = np.lexsort([*x.T, role])
    x, role, good = x[order], role[order], np.array([r[1] == 1 for r in taken], bool)[order]
    prior = separate(x[role == 0], x[role == 1], mean, scale)
    net = fit(x[role == 0], x[role == 1], prior, mean, scale)
    net.settle(x[role == 0], x[role == 1], prior)
    if platt:
        net.calibrate(x[role == 2], good[role == 2])
    known.drop()
    chosen.drop()
    return net


def score_quality(docs: DataFrame, labels: DataFrame, held_fold: int = 0, sample: int = 20000, columns: list[str] | None = None, platt: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (all, if not told) with held_out and score; columns of these names are replaced."""
    rest = [c for c in with_columns_last(docs, ["held_out", "score"]) if columns is None or c in columns]
    rows = stage(described(docs.withColumn("__tm_doc", F.col("doc_id")), [*rest, "__tm_doc"]), "described")
    net = learn(rows.select(F.col("__tm_doc").alias("doc_id"), "__tm_x"), labels, held_fold, sample, platt)
    schema = StructType([*rows.select("__tm_doc", *rest).schema.fields]).add("score", "double")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores(net, batch.column(batch.num_columns - 1))], schema.names)

    scored = rows.select("__tm_doc", *rest, "__tm_x").mapInArrow(run, schema)
    return scored.select(*rest, (fold(F.col("__tm_doc")) == held_fold).alias("held_out"), "score")


def scores(net: Network, x: pa.Array) -> pa.Array:
    return pa.array(net.score(np.asarray(x.flatten(), np.float64).reshape(-1, WIDTH)), pa.float64())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their own columns."""
    rows = stage(described(docs, docs.columns), "described")
    net, names = learn(rows.select("doc_id", "__tm_x"), labels, **how), docs.columns

    def run(batches):
        for batch in batches:
            good = np.asarray(scores(net, batch.column(batch.num_columns - 1))) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
