import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import lower
from tidemark.llm.quality import describe, fit, keep_good, score_quality, separate

R = random.Random(9)
VOC = ["the", "of", "and", "river", "stone", "light", "harbour", "walked", "quiet", "morning", "letter", "found", "under", "bridge"]


def good():
    return " ".join(" ".join(R.choice(VOC) for _ in range(R.randint(5, 12))).capitalize() + "." for _ in range(R.randint(2, 9)))


def junk():
    kind = R.randrange(3)
    words = good().split()
    return [" ".join(w + "$$$" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40)][kind]


IS_GOOD = {d: R.random() < 0.8 for d in range(900)}
ROWS = [(d, good() if IS_GOOD[d] else junk()) for d in IS_GOOD] + [(900, None), (901, ""), (None, "No id here."), (5, "Repeated row."), (902, "word " * 50000)]


def tables(spark, docs_of, rows=ROWS):
    labels = [(d, int(g), 0) for d, g in IS_GOOD.items() if d % 2] + [(None, 1, 0), (3, None, 0), (7777, 0, 1), (1, int(IS_GOOD[1]), 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs_of):
    docs, labels = tables(spark, docs_of)
    out = score_quality(docs, labels)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {"uid", "lang", "held_out", "score"} <= set(out.columns)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score >= 0.3, IS_GOOD[r.doc_id]) for r in rows if r.held_out and r.doc_id < 900 and r.doc_id != 5]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.score >= 0.3}


def test_scores_do_not_depend_on_ids_or_sources(spark, docs_of):
    docs, labels = tables(spark, docs_of)
    by = {}
    for r in score_quality(docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100000).withColumn("source", docs.lang)), labels).collect():
        by.setdefault(r.text, set()).add(round(r.score, 12))
    assert all(len(s) == 1 for s in by.values())


def test_no_labels_and_no_rows(spark, docs_of):
    docs, labels = tables(spark, docs_of, ROWS[:20])
    assert score_quality(docs, labels.limit(0)).count() == 20
    assert score_quality(docs_of([]), labels).collect() == []
    assert len(describe(None)) == len(describe("Eins zwei")) and lower("A") == "a"


def test_risk_separates_two_clouds():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1, 0.7, (2000, 40)), rng.normal(-1, 0.7, (2000, 40))
    net = fit(pos[:800], np.vstack([pos[800:], neg[:600]]), 2 / 3)
    assert (net.logit(pos[:500]) > 0).mean() > 0.95 and (net.logit(neg[600:]) < 0).mean() > 0.95


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_of_mixtures(prior):
    rng = np.random.default_rng(3)
    draw = lambda n, c: rng.normal(c, 1.0, (n, 40))
    mixed = np.vstack([draw(int(4000 * prior), 0.5), draw(int(4000 * (1 - prior)), -0.5)])
    assert abs(separate(draw(3000, 0.5), mixed, mixed.mean(0), mixed.std(0)) - prior) < 0.06


def test_risk_equals_its_formula():
    """One full-batch step moves the weights against the gradient of the risk, found here by differences."""
    rng = np.random.default_rng(5)
    p, u, prior = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (60, 4)), 0.4
    net = fit(p, u, prior, hidden=3, epochs=5)
    x, y = ((v - net.mean) / net.scale for v in (p, u))

    def risk():
        zp, zu = (np.tanh(v @ net.parts[0] + net.parts[1]) @ net.parts[2] + net.parts[3][0] for v in (x, y))
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    before = risk()
    sig = lambda z: 1 / (1 + np.exp(-z))
    zp, zu = (np.tanh(v @ net.parts[0] + net.parts[1]) @ net.parts[2] + net.parts[3][0] for v in (x, y))
    grads = [a + b for a, b in zip(net.slopes(y, sig(zu) / len(zu)), net.slopes(x, prior * -np.ones(len(zp)) / len(zp)))]
    for i, g in enumerate(grads):
        flat = net.parts[i].reshape(-1)
        for j in range(len(flat)):
            flat[j] += 1e-6
            assert (risk() - before) / 1e-6 == pytest.approx(g.reshape(-1)[j], abs=1e-4)
            flat[j] -= 1e-6
