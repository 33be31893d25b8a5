import random
import re

import numpy as np
import pytest

from tests.llm.conftest import lower
from tidemark.llm.decontaminate import find_matches, remove_contaminated, suffix_order

R = random.Random(4)
VOC = [f"w{i}" for i in range(12)] + ["été", "ñ", "x9"]
ITEMS = [(i, " ".join(R.choice(VOC) for _ in range(R.choice([3, 5, 9, 10, 11, 25])))) for i in range(12)]
ITEMS += [(20, None), (21, "..."), (22, ITEMS[0][1].upper()), (None, "w1 w2 w3"), (23, "alone")]
DOCS = [(1, None), (2, ""), (3, "Alone!"), (4, "w1-w2_w3,w4" * 3)]
for d in range(5, 60):
    words = [R.choice(VOC) for _ in range(R.choice([0, 3, 40, 200]))]
    for _ in range(R.choice([0, 1, 2])):
        t = R.choice([x for x in ITEMS if x[1]])[1]
        words[len(words) // 2 : len(words) // 2] = t.split()[R.choice([0, 1]) :]
    DOCS.append((d, ", ".join(words).upper() if d % 2 else "\n".join(words)))
DOCS += [DOCS[-1], (None, DOCS[-2][1]), (70, "w1 " * 30000)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute():
    out = []
    windows = {}
    for item, t in ITEMS:
        w = words(t)
        if item is not None and w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for d, t in DOCS:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((d, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [32 << 20, 120])
def test_equals_brute_force(spark, docs_of, piece):
    # shards are cut inside workers, so small documents share one and the long one closes it
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_matches(docs_of(DOCS), bench, piece_bytes=piece).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got), key=str) == brute()
    for r in got:
        assert r.n_items == len(r.items) == len({s.item_id for s in r.spans})
        assert all(0 <= s.start_word < s.end_word <= r.n_words for s in r.spans)
    clean = remove_contaminated(docs_of(DOCS), bench)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted((d or -1) for d, *_, bad in brute() if not bad)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_matches(docs_of([]), none).collect() == []
    assert [r.contaminated for r in find_matches(docs_of(DOCS[:5]), none).collect()] == [False] * 5


def test_small_shards_find_the_same():
    from tidemark.llm import decontaminate as d

    tests = d.Tests([(str(i), t) for i, t in ITEMS if t and i is not None], 10)
    known = d.Known(tests.vocabulary).__getitem__
    shard = [np.array([known(w) for w in d.words_of(t)], np.int32) for _, t in DOCS]
    assert d.judge(tests, shard) == [spans for one in shard for spans in d.judge(tests, [one])]


def brute_matches(item, doc, window=10):
    """(start in doc, length, start in item) of every verbatim match that is as long as a window and as long as can be."""
    out = []
    for p in range(len(doc)):
        for i in range(len(item)):
            if item[i] == doc[p] and not (i and p and item[i - 1] == doc[p - 1]):
                n = 0
                while i + n < len(item) and p + n < len(doc) and item[i + n] == doc[p + n]:
                    n += 1
                if n >= min(window, len(item)):
                    out.append((p, n, i))
    return out


@pytest.mark.parametrize("piece", [32 << 20, 120])
def test_longest_matches_equal_brute_force(spark, docs_of, piece):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w)), (2, " ".join(w[5:30] + w[:12])), (3, "a b a b a b a b a b a b a"), (4, "w3 w4")]
    docs = [(1, " ".join(w[:12] + w[20:32])), (2, " ".join(w[:25] + ["x"] + w[10:40])), (3, "a b " * 20), (4, " ".join(w[5:30] + w[0:12] + w)), (5, "w3 w4 w3"), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in find_matches(docs_of(docs), bench, piece_bytes=piece).collect():
        got = sorted((s.item_id, s.start_word, s.end_word - s.start_word, s.item_word) for s in r.spans)
        text = dict(docs)[r.doc_id]
        assert got == sorted((str(k), *m) for k, t in items for m in brute_matches(t.split(), words(text)))


def test_suffix_order_is_that_of_whole_suffixes():
    g = np.random.default_rng(0)
    for kinds in (1, 2, 5):
        x = np.concatenate([np.append(g.integers(1, kinds + 1, g.integers(0, 40)), 0) for _ in range(20)])
        at = np.flatnonzero(x)
        end = np.flatnonzero(x == 0)
        key = lambda p: x[p : end[np.searchsorted(end, p)]].tolist()
        order = suffix_order(x, at).tolist()
        assert sorted(order) == at.tolist() and [key(p) for p in order] == sorted(map(key, at))
