import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from tests.llm.conftest import lower
from tidemark.llm.simhash import drop_near_duplicates, near_copies

R = random.Random(5)
VOC = [f"word{i}" for i in range(3000)]


def shingles(text, k=5):
    w = lower(text).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near(base, edits):
    """A copy with every tenth word of the first 10 * ``edits`` replaced, which costs five shingles each."""
    return [f"new{R.random()}" if i % 10 == 5 and i < 10 * edits else w for i, w in enumerate(base)]


def pairs():
    """Pairs at known overlaps: 304 shingles, of which 5 an edit differ."""
    rows = []
    for i in range(240):
        base = [R.choice(VOC) for _ in range(308)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near(base, 6 if i % 2 else 7)))]
    return rows


def test_pairs_at_the_overlap_are_found_and_none_below(docs_of):
    rows = pairs()
    overlap = {2 * i + 1: jaccard(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) for i in range(240)}
    want = {d for d, j in overlap.items() if j >= 0.8}
    assert len(want) == 120 and all(j > 0.75 for j in overlap.values())
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(rows)).collect()}
    assert want & kept == set() and set(overlap) - want <= kept


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {d: rows[label[i]][0] for i, (d, _) in enumerate(rows)}


def alike(groups, each, width=204):
    """Texts off one base by up to 30 %: some link, some only by way of others, some not at all."""
    rows = []
    for _ in range(groups):
        base = [R.choice(VOC) for _ in range(width)]
        for _ in range(each):
            at = set(R.sample(range(20), R.randint(0, 8)))
            rows.append((len(rows), " ".join(f"new{R.random()}" if i % 10 == 5 and i // 10 in at else w for i, w in enumerate(base))))
    return rows


@pytest.mark.parametrize("how", [{}, {"chunk_texts": 7}, {"bucket": 5, "chunk_bytes": 20000}])
def test_groups_equal_all_pairs(docs_of, how):
    rows = alike(2, 60)
    want = brute(rows)
    assert 4 < len(set(want.values())) < 100
    assert {r.doc_id: r.component_id for r in near_copies(docs_of(rows), **how).collect()} == want


def test_repeated_and_missing_ids(docs_of):
    base, other = (" ".join(R.choice(VOC) for _ in range(80)) for _ in range(2))
    rows = [(7, base)] * 300 + [(None, base)] * 300 + [(7, other), (9, other + " end"), (10, base + " end"), (11, None), (12, " "), (13, "\n")]
    got = Counter((r.doc_id, r.component_id) for r in near_copies(docs_of(rows)).collect())
    assert got == {(7, 7): 301, (None, 7): 300, (9, 7): 1, (10, 7): 1, (11, 11): 1, (12, 11): 1, (13, 11): 1}
    kept = Counter(r.doc_id for r in drop_near_duplicates(docs_of(rows)).collect())
    assert kept == {7: 1, None: 300, 11: 1}


def test_very_long_texts(docs_of):
    base = [R.choice(VOC) for _ in range(300000)]
    rows = [(1, " ".join(base)), (2, " ".join(w if i % 100 else "x" for i, w in enumerate(base))), (3, " ".join(base[:150000])), (4, "same " * 300000), (5, "same " * 200000)]
    assert {r.doc_id: r.component_id for r in near_copies(docs_of(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_all_pairs_of_a_table(spark):
    """Every pair at 0.8 or more, found by counting common shingles over an inverted index, is in one group."""
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("needs the synthetic tables")
    docs = spark.read.parquet(str(path)).select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids: dict = {}
    sets = {d: [ids.setdefault(s, len(ids)) for s in shingles(t)] for d, t in rows.items()}
    posted, links = defaultdict(list), []
    for d, own in sets.items():
        common = Counter(x for s in own for x in posted[s])
        links += [(x, d) for x, n in common.items() if n >= 0.8 * (len(own) + len(sets[x]) - n)]
        for s in own:
            posted[s].append(d)
    label = {d: d for d in rows}
    find = lambda d: d if label[d] == d else find(label[d])
    blank = [d for d in rows if not sets[d]]
    links += list(zip(blank, blank[1:]))
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 100 and found / len(links) >= 0.9, (found, len(links))
    # nothing else is linked: each group of the query lies within one of brute force
    assert all(find(d) == find(c) for d, c in got.items())
    print(f"{found} of {len(links)} links at 0.8 or more found")
