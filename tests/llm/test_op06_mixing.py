import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources, pivot, plan_mix

R = random.Random(6)
ROWS = [(d, R.choice(["a", "a", "a", "b", "c", "Z", "é", None, "tiny"] if d % 50 else ["tiny"]), " ".join("w" for _ in range(R.choice([0, 1, 5, 30, 200])))) for d in range(400)]
ROWS += [(400, "empty", ""), (401, "empty", None), (402, "one", "w x"), (None, "a", "x y z"), (7, "a", "again and again"), (7, "a", "again and again")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("uid", F.lit("x")).withColumn("block", F.lit(None).cast("int")).repartition(5)


def brute_targets():
    size = {}
    for _, s, t in ROWS:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, held = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        target = {s: 2.0 * size[s] if s in held else left * weight[s] / free for s in names}
        above = {s for s in names if s not in held and target[s] > 2 * size[s]}
        if not above:
            return size, target
        held |= above


@pytest.mark.parametrize("leaf,fan_in", [(4096, 64), (8, 3)])
def test_targets_words_and_bounds(spark, leaf, fan_in):
    rows = plan_mix(table(spark), leaf=leaf, fan_in=fan_in).collect()
    size, target = brute_targets()
    assert len(rows) == len(ROWS)
    words, largest = {}, {}
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        assert abs(r.copies - r.target / max(1, r.source_size)) < 1 or r.size == 0
        words[r.source] = words.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(abs(words[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in words)


def test_reruns_agree(spark):
    one = sorted((str(r.doc_id), r.size, r.copies) for r in plan_mix(table(spark), leaf=16, fan_in=4).collect())
    two = sorted((str(r.doc_id), r.size, r.copies) for r in plan_mix(table(spark).repartition(2), leaf=16, fan_in=4).collect())
    assert one == two


def test_pivot_keeps_words_and_expectation():
    hits = 0
    for seed in range(3000):
        done, held = pivot([1, 2, 3], [10, 20, 30], [0.3, 0.3, 0.3], seed)
        got = dict(done) | ({held[0]: held[1]} if held else {})
        assert sum(s * got[i] for i, s in enumerate([10, 20, 30])) == pytest.approx(18)
        hits += got[0]
    assert hits / 3000 == pytest.approx(0.3, abs=0.03)


def test_mix_and_no_rows(spark):
    mixed = mix_sources(table(spark))
    assert mixed.columns == ["doc_id", "source", "text", "uid", "block", "copies", "taken"]
    assert all(r.copies > 0 and r.taken == r.copies * len(r.text.split()) for r in mixed.collect())
    planned = sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in plan_mix(table(spark)).collect() if r.copies)
    assert sorted((str(r.doc_id), str(r.source), len(r.text.split()), r.copies) for r in mixed.collect()) == planned
    assert mix_sources(table(spark, [])).collect() == []


def test_a_third_repeated_and_a_third_without_ids(spark):
    rows = [(7, "a", "w w w")] * 600 + [(None, "a", "w w")] * 600 + [(1000 + i, "b", "w " * (1 + i % 5)) for i in range(600)]
    rows = [*rows, (5, "c", "word " * 300000)]
    out = plan_mix(table(spark, rows), leaf=64, fan_in=4).collect()
    words = {}
    for r in out:
        words.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(out) == len(rows) and all(abs(t - w) <= 3 for s, (t, w) in words.items() if s != "c")
    mixed = mix_sources(table(spark, rows), leaf=64, fan_in=4)
    assert sum(r.taken for r in mixed.select("taken").collect()) == pytest.approx(sum(w for _, w in words.values()), abs=1)
