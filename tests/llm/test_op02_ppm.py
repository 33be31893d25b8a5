import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import lower
from tidemark.llm import ppm
from tidemark.llm.ppm import END, gram_counts, score_documents

R = random.Random(2)
VOC = ["the", "tide", "Ebbs", "slow", "été", "ñu", "and", "andes"]
ROWS = [(d, " ".join(R.choice(VOC) for _ in range(R.randint(0, 30)))) for d in range(60)]
ROWS += [(60, None), (61, ""), (62, "zzz qqq 中文"), (63, "  \t\n"), (None, "the tide xx"), (5, "the\ntide"), (5, "the\ntide"), (64, "tide " * 30000)]


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 == 1


class Brute:
    def __init__(self, texts, order):
        self.order, self.seen = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = bytes([END]) * order + t + bytes([END])
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.seen[j][s[i - j : i]][s[i]] += 1

    def share(self, context, symbol):
        p, out = 1.0, set()
        for j in range(self.order, -1, -1):
            after = self.seen[j].get(context[len(context) - j :])
            if not after:
                continue
            left = {s: c for s, c in after.items() if s not in out}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return p * left[symbol] / total
                p *= len(left) / total
            out = set(after)
        return p / (256 - len(out))

    def score(self, t):
        s = bytes([END]) * self.order + t + bytes([END])
        return sum(math.log10(self.share(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def brute(rows, order):
    low = [(d, lower(t).encode()) for d, t in rows]
    learn = [t for d, t in low if not held(d)]
    model, words = Brute(learn, order), Counter(w for t in learn for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    out = []
    for d, t in low:
        own = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((str(d), held(d), len(own), sum(words[w] > 0 for w in own), n, round(base, 6), round(model.score(t), 6)))
    return sorted(out)


@pytest.mark.parametrize("order,group", [(4, 24 << 20), (2, 300), (1, 24 << 20)])
def test_equals_brute_force(docs_of, order, group):
    got = score_documents(docs_of(ROWS), order=order, group_bytes=group).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    want = brute(ROWS, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-4 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def test_shares_of_a_context_add_up():
    model = Brute([lower(t).encode() for _, t in ROWS[:40]], 3)
    for context in (b"the", b"e t", b"zzz", b"\xffth"):
        assert sum(model.share(context, s) for s in range(256)) == pytest.approx(1)


def test_gram_counts_over_chunks(monkeypatch):
    from tidemark.llm import ppm

    texts = [lower(t).encode() for _, t in ROWS]
    whole = gram_counts(texts, 3)
    monkeypatch.setattr(ppm, "CHUNK", 7)
    parts = gram_counts(texts, 3)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].sum() == sum(len(t) + 1 for t in texts)


def test_nothing_to_learn_and_no_rows(docs_of):
    only = [(d, "abc") for d in range(20) if held(d)]
    rows = score_documents(docs_of(only)).collect()
    assert all(r.score == pytest.approx(-4 * math.log10(256)) and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert score_documents(docs_of([])).collect() == []


def test_repeated_rows_are_dealt_to_all_groups(docs_of, monkeypatch):
    monkeypatch.setattr(ppm, "MANY", 5)
    rows = [(1, "same text of many rows")] * 40 + [(None, f"no id {i % 3}") for i in range(40)] + [(d, f"other {d} text") for d in range(3, 30)]
    one = sorted(map(str, ppm.score_documents(docs_of(rows), group_bytes=1 << 20).collect()))
    assert len(one) == len(rows)
    many = ppm.score_documents(docs_of(rows), group_bytes=200).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, many)) == sorted(map(key, ppm.score_documents(docs_of(rows)).collect()))
