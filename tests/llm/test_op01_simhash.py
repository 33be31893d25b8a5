import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import lower
from tidemark.llm.common import components
from tidemark.llm.simhash import CUTS, drop_near_duplicates, fingerprint, forest, lane_bits, links, local_variants, near_copies, near_groups, shingle_hashes, third_keys, variants, words_of

R = random.Random(1)
VOC = [f"word{i}" for i in range(400)]


def text(n):
    return [R.choice(VOC) for _ in range(n)]


BASE = [text(n) for n in (900, 700, 1500, 60, 5, 1, 4, 3)]
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "ÀB cd"), (7, "àb cd"), (None, "one")]
for b in BASE:
    for _ in range(6):
        copy = list(b)
        for _ in range(R.choice([0, 0, 1, 2, 3])):
            copy[R.randrange(len(copy))] = R.choice(VOC)
        ROWS.append((len(ROWS) + 100, R.choice([" ", "\n", "  "]).join(copy).upper() if R.random() < 0.5 else " ".join(copy)))
ROWS.append(ROWS[-1])
ROWS.append((5000, "long " * 60000))


def brute_print(t, k=4):
    words = [w for w in lower(t).replace("\t", " ").replace("\n", " ").split(" ") if w]
    n = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if n else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows, bits=4):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                label[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", best[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bucket", [8192, 3])
def test_equals_brute_force(docs_of, bucket):
    got = near_groups(docs_of(ROWS), bucket=bucket).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(ROWS)


def test_all_links_up_to_five_bits_and_large_buckets(spark):
    rng = np.random.default_rng(2)
    prints = []
    for _ in range(12):
        seed = int(rng.integers(0, 2**63))
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.append(seed ^ sum(1 << int(b) for b in flips))
    prints = sorted(set(prints))
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "rep long, f0 long")
    for bits in (4, 5):
        want = {}
        for a, b in forest(np.array(prints, np.uint64)[:, None], np.arange(len(prints)), bits):
            want.setdefault(a, set()).add(b)
        truth = {r.node: r.label for r in components(spark.createDataFrame([(a, b) for a in want for b in want[a]], "a long, b long")).collect()}
        for bucket in (8192, 4):
            assert {r.node: r.label for r in components(links(df, ["f0"], bits, bucket, 64 if bucket == 4 else 1 << 18)).collect()} == truth
    with pytest.raises(ValueError):
        links(df, ["f0"], 6)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 209)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stage_keeps_one_of_each_group(docs_of):
    out = drop_near_duplicates(docs_of(ROWS))
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs_of([]).columns and len(kept) == len(set(kept))
    near = [d for d, t in ROWS if t and len(t.split()) > 500 and d != 5000]
    assert 3 <= sum(d in kept for d in near) <= 5 and {1, 4, 6, 5000, None} <= set(kept) and not {2, 3, 5} & set(kept)
    assert drop_near_duplicates(docs_of([])).collect() == []


def test_lanes_agree_with_one():
    hashes = shingle_hashes(words_of("a b c d e f g " * 300), 4)
    many = fingerprint(hashes, 4)
    assert many[0] == fingerprint(hashes, 1)[0] and len(set(many)) == 4
    for lane in range(4):
        votes = [int(h) for h in lane_bits(hashes, lane)]
        assert many[lane] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))
    assert fingerprint(shingle_hashes([], 4), 2) == [0, 0]


def test_empty_tables(docs_of):
    assert near_groups(docs_of([])).collect() == [] and near_copies(docs_of([])).collect() == []


def test_variants_are_all_segments_with_one_bit_out(spark):
    """64 variants a lane, the same in Spark and in a task; two prints share one just if a segment differs by a bit at most."""
    rng = np.random.default_rng(4)
    names = ["f0", "f1"]
    prints = rng.integers(-(2**63), 2**63, (40, 2), np.int64)
    for i in range(20):  # pairs that differ by a few bits in some segments
        prints[i + 20] = prints[i] ^ np.array([sum(1 << int(b) for b in rng.choice(63, 3 + i % 6, False)) for _ in range(2)])
    df = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "rep long, f0 long, f1 long")
    keyed = df.select("rep", *names, F.explode(third_keys(names)).alias("key"))
    told = {}
    for r in keyed.select("rep", F.explode(variants(names, F.col("key"))).alias("v")).collect():
        told.setdefault(r.rep, set()).add(r.v)
    assert all(len(v) == 128 for v in told.values())
    rows = keyed.collect()
    key, lanes, mine = np.array([r.key for r in rows], np.int64), np.array([[r.f0, r.f1] for r in rows], np.int64).view(np.uint64), {}
    for at, v in local_variants(key, lanes):
        for i, x in zip(at, v):
            mine.setdefault(rows[i].rep, set()).add(int(x))
    assert mine == told
    for i in range(40):
        for j in range(i):
            x = (prints[i] ^ prints[j]).view(np.uint64)
            near = any(bin(int(lane) >> low & (1 << high - low) - 1).count("1") <= 1 for lane in x for low, high in zip(CUTS, CUTS[1:]))
            assert bool(told[i] & told[j]) == near
