import random
import re
import time

import duckdb

from tests.llm.conftest import lower
from tidemark.llm.licenses import NAMES, PHRASES, TEMPLATES, scan_licenses
from tidemark.llm.registry import ORACLES, QUERIES

R = random.Random(10)
VOC = ["the", "of", "gnu", "general", "public", "license", "apache", "mit", "cc", "by", "straße", "x1", "free"]
ROWS = [(1, None), (2, ""), (3, "MIT"), (4, "MIT License"), (5, "mit-license_apache  LICENSE. cc/BY"), (6, "..."), (7, "cc by" * 2), (8, "ü cc by")]
ROWS += [(d, R.choice([" ", "-", ", "]).join(R.choice(VOC) for _ in range(R.choice([3, 20, 300]))).title()) for d in range(10, 60)]
ROWS += [(60, "mit license " * 20000), (None, "apache license"), (61, "gnu gnu general public license"), (61, "gnu gnu general public license")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute(t):
    w, places = words(t), []
    for phrase, label in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def test_places_equal_brute_force(docs_of):
    rows = scan_licenses(docs_of(ROWS)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in rows)
    want = sorted((str(d), *[x if i < 2 or i == 4 else str(x) for i, x in enumerate(brute(t))]) for d, t in ROWS)
    assert got == want
    for r in rows:
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_changed_templates_get_the_methods_labels(docs_of):
    texts, want = [], []
    for text, label in TEMPLATES:
        w = text.split()
        w[len(w) // 2] = "changed"
        w.insert(len(w) // 3, "inserted")
        texts.append("some words before " + " ".join(w) + " and after")
        want.append(label)
        texts.append(" ".join(R.sample(w, len(w))))
        want.append(None)
    rows = sorted(scan_licenses(docs_of(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    for r, label in zip(rows, want):
        assert (label in r.labels) if label else not set(r.labels) - set(r.base_labels)


def test_runs_no_python_and_takes_no_rows(docs_of):
    plan = scan_licenses(docs_of(ROWS[:3]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert scan_licenses(docs_of([])).collect() == []


def test_names_with_versions_get_labels_of_their_own(docs_of):
    texts = ["under the GNU General Public License, version 3.", "CC BY-NC 4.0", "Apache License, Version 2.0", "the MIT License", "cc by the sea 4 0", "GNU General Public license public version 3"]
    rows = sorted(scan_licenses(docs_of(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in rows] == [["gpl", "gpl-3.0"], ["cc-by", "cc-by-nc-4.0"], ["apache", "apache-2.0"], ["mit"], ["cc-by"], ["gpl"]]
    rows = scan_licenses(docs_of([(i, f"a {text} b") for i, (text, _) in enumerate(NAMES)])).collect()
    assert all(NAMES[r.doc_id][1] in r.labels and r.score == 1 for r in rows)


def test_a_million_words_take_seconds(docs_of):
    began = time.perf_counter()
    got = scan_licenses(docs_of([(1, "word of mit license " * 250000)])).collect()[0]
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (1000000, 250000, 2, 999998)
    assert time.perf_counter() - began < 60


def test_equals_the_oracle(spark, tmp_path):
    words = sorted({w for t, _ in [*PHRASES, *NAMES, *TEMPLATES[:3]] for w in t.split()})
    rows = [(d, " ".join(R.choice([R.choice(words), R.choice([*PHRASES, *NAMES, *TEMPLATES])[0]]) for _ in range(R.choice([0, 1, 8, 40])))) for d in range(150)]
    rows += [(200, None)] + [(300 + i, " ".join(w for w in t.split() if R.random() > 0.2)) for i, (t, _) in enumerate(TEMPLATES * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op10_licenses"])
    got = QUERIES["op10_licenses"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
