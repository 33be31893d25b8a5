import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import lower
from tidemark.llm.exact_dedup import exact_groups

ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, "hello worlD "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "hello world"),
    (8, "a" * 100 + "b" * 37), (9, "A" * 100 + "b" * 37), (10, "a" * 100 + "b" * 36), (11, "b" * 37 + "a" * 100), (12, "a" * 500),
    (13, "a" * 501), (14, "A" * 501), (2, "hello world"), (15, "ab\ncd"), (16, "ab\ncD"), (17, "straße ÀB" * 9), (18, "straße ÀB" * 9),
]


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[lower(t)].append((d, i))
    out = []
    for t, members in groups.items():
        keep = max((d for d, _ in members if d is not None), default=None)
        for d, _ in members:
            out.append((d, keep, len(members), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3))])
@pytest.mark.parametrize("block", [8, 1024])
def test_equals_brute_force(docs_of, route, block):
    got = exact_groups(docs_of(ROWS), block, route).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({lower(t) for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty(docs_of):
    assert exact_groups(docs_of([])).collect() == []


def test_very_long_texts_and_a_third_alike(docs_of):
    long = "tide " * 400000
    rows = [(d, long if d < 20 else f"{long}{d % 5}" if d < 40 else "same" if d < 240 else f"own {d}") for d in range(600)] + [(None, "same")] * 200
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_groups(docs_of(rows)).collect()), key=str) == brute(rows)
