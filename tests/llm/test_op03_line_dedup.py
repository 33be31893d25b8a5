import re
from collections import defaultdict

import pytest

from tests.llm.conftest import lower
from tidemark.llm import line_dedup
from tidemark.llm.line_dedup import LineRuns, dedup_lines, line_keys

LONG = "This line is long enough to count"
ACC = "é" * 20
ROWS = [
    (1, f"{LONG}\nshort\n{LONG.upper()}\nown one of the first document"), (2, f"  {LONG}\t\r\nx\n"), (3, f"{LONG}"), (4, None), (5, ""),
    (6, f"{ACC}\n{'é' * 19}"), (7, f"{ACC}\n{'é' * 19}"), (8, f"\x0b{ACC}\x0c\n{'é' * 19}"), (9, "É" * 20), (10, f"a line in only two documents\n{ACC}"),
    (11, "a line in only two documents"), (12, "\n\n\n"), (None, LONG), (3, f"{LONG}"), (13, f"{LONG} \n{LONG} "), (14, ("w" * 30 + "\n") * 4),
    (15, "w" * 30), (16, "x\n" + "w" * 30),
]


def brute(rows, least=20, docs=3):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < docs or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 3), (5, 2)])
def test_equals_brute_force(docs_of, batches, fanout):
    df = dedup_lines(docs_of(ROWS), batches=batches, fanout=fanout)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=str)
    assert got == brute(ROWS)
    assert {"uid", "h", "lang", "source"} <= set(df.columns)


def test_runs_hold_each_key_once_and_compact(docs_of):
    store = LineRuns(fanout=2)
    for part in (ROWS[:6], ROWS[6:9], ROWS[9:12], ROWS[14:]):
        store.add(line_keys(docs_of(part), 20))
    held = [(r.h1, r.h2) for run in store.runs() for r in run.df.collect()]
    assert len(held) == len(set(held)) and len(store.levels) >= 2
    assert max(len(level) for level in store.levels) < 2
    assert {r.n for r in store.totals().collect()} >= {1, 3}


def test_runs_merge_without_shuffle_or_sort(spark, docs_of):
    store = LineRuns(fanout=4, buckets=3)
    store.add(line_keys(docs_of(ROWS[:6]), 20))
    other = line_dedup.Run(store.runs()[0].df, 3, "copy")
    with line_dedup.merging(spark):
        plan = other.df.hint("merge").join(store.runs()[0].df.select("h1", "h2"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    for run in (other, store):
        run.drop()


def test_very_long_texts_and_hot_lines(docs_of):
    rows = [(d, "\n".join([LONG, f"only in document {d} of them", LONG.upper()])) for d in range(300)] + [(1000, (LONG + "\n") * 100000), (1001, "x" * 3000000)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in dedup_lines(docs_of(rows)).collect())
    assert got == sorted(brute(rows))


def test_no_rows(docs_of):
    assert dedup_lines(docs_of([])).collect() == []


def test_key():
    assert line_dedup.line_key(b" a ", 2) is None and re.match(r"\(-?\d+, -?\d+\)", str(line_dedup.line_key("ÄÖ".encode(), 2)))
