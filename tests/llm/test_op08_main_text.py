import random
import time
from collections import defaultdict

import pytest

from tidemark.llm.main_text import Page, extract_main_text, main_blocks

CASES = [
    (None, ""),
    ("", ""),
    ("plain   text &amp; more", "plain text & more"),
    ("<html><head><title>T</title></head><body><nav><p>menu</p></nav><article><h1>Head&nbsp;line</h1><p><b>One<br>two.<br><p>Three <i>it</i>alic</p></article><footer>foot</footer></body></html>", "Head line\nOne two.\nThree italic"),
    ('<body><script>var t="</p><article>x";</script><header>top</header><main><header>Own title</header><p>a\n b</p><aside>side</aside></main>', "Own title\na b"),
    ('<div class="ad">buy</div><div id="cookie-notice">ok?</div><p>text</p><form><p>f</p></form><div class="comments"><p>first!</p></div>', "text"),
    ('<article><p>x</p><div class="reader-comments"><p>c</p></div><p>y</p></div></section></article><p>after</p>', "x\ny"),
    ("<p>a</p>tail &lt;b&gt; &#233; &eacute;<!-- c <p>no</p> --><p hidden>h</p><div role=navigation>n</div>", "a\ntail <b> é é"),
    ("<ul><li>one<li>two <b>bold</b></ul><table><tr><td>c1<td>c2</table>", "one\ntwo bold\nc1\nc2"),
    ("<p>unclosed <b>bold <p>next", "unclosed bold\nnext"),
    ("<article><style>p{}</style><p>1 &lt; 2<script>x('</article>')</script> and</p><!-- open <p>gone</p>", "1 < 2 and"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article><p>salads and adverbs</p><p class='lead shadow'>kept</p></article>", "salads and adverbs\nkept"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>" + "w " * 200000 + "</p>", "w " * 199999 + "w"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_blocks(page, text):
    assert "\n".join(main_blocks(Page(page), set())) == text


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string").repartition(3)


def test_site_templates_go_and_content_stays(spark):
    box = "<div><p>Join our list</p></div>"
    rows = [("http://a.com/1", f"<body>{box}<div><p>Story number {i}</p></div><p>{'Quoted' if i % 2 else 'Other'} passage</p></body>") for i in range(30)]
    rows += [("http://b.com/1", f"<body>{box}<p>Page {i}</p></body>") for i in range(5)]
    rows += [("http://c.com/1", "<article><h1>Copied</h1><div><p>whole page</p></div></article>")] * 40
    rows += [("http://d.com/1", f"<article>{box}<p>Same paragraph</p><p>{i}</p></article>") for i in range(30)] + [(None, None), ("x", "")]
    out = extract_main_text(pages(spark, rows))
    got = {r.page_id: r.text for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for i, (url, _) in enumerate(rows):
        if url and "a.com" in url:
            assert got[i] == f"Story number {i}"
        elif url and "b.com" in url:
            assert got[i] == f"Page {i - 30}"
        elif url and "c.com" in url:
            assert got[i] == "Copied\nwhole page"
        elif url and "d.com" in url:
            assert got[i] == f"Same paragraph\n{i - 75}"
        else:
            assert got[i] == ""
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert extract_main_text(pages(spark, [])).collect() == []


def test_templates_by_shape_go_though_their_words_change(spark):
    w = random.Random(3)
    some = lambda n: " ".join(w.choice(["tide", "mud", "ebb", "wader", "sluice"]) + str(w.randrange(999)) for _ in range(n))
    rows = []
    for i in range(40):
        links = "".join(f"<li><a href=/{some(1)}>{some(1)}</a></li>" for _ in range(w.randint(2, 6)))
        rows.append(("http://s.org/x", f"<div class=top><ul>{links}</ul></div><div class=text><h1>{some(3)}</h1><p>{some(90)}</p><p>{some(60)}</p></div><div class=last><p>{some(5)}</p></div>"))
    for r, (_, html) in zip(extract_main_text(pages(spark, rows)).orderBy("page_id").collect(), rows):
        inner = html.split("<div class=text>")[1].split("</div>")[0]
        assert r.text == "\n".join(x.split("<")[0] for x in inner.replace("<h1>", "<p>").split("<p>")[1:])


@pytest.mark.parametrize("most_sent", [100000, 0])
def test_templates_equal_brute_force(spark, most_sent):
    """Random pages of containers and paragraphs: a container goes if its text is in five or more different pages of the host."""
    w = random.Random(8)
    pool = [f"<div><p>box {i}</p></div>" for i in range(14)]
    rows = []
    for i in range(120):
        parts = [w.choice(pool) for _ in range(w.randint(0, 5))] + [f"<section><p>own {i} {'word ' * 30}</p></section>"]
        rows.append((w.choice(["http://a.net", "http://b.net/?q", "http://c.net/d"]), "".join(w.sample(parts, len(parts)))))
    rows += rows[:30]
    seen = defaultdict(set)
    for url, html in rows:
        for part in pool:
            if part in html:
                seen[url, part].add(html)
    out = extract_main_text(pages(spark, rows), least_share=2.0, most_sent=most_sent).collect()
    for r in out:
        url, html = rows[r.page_id]
        for part in pool:
            if len(seen[url, part]) >= 5:
                html = html.replace(part, "")
        assert r.text == "\n".join(" ".join(x.split("</p>")[0].split()) for x in html.split("<p>")[1:])
    assert any(len(pages) >= 5 for pages in seen.values()) and any(len(pages) < 5 for pages in seen.values())


@pytest.mark.parametrize(
    "page",
    ["<a b" * 250000, "<div>" * 50000 + "x", "<b>" * 50000 + "</i>" * 50000, "<i><article>" + "<b>" * 50000 + "</i>" * 50000, "<b><p>x" * 50000, "<p title='" * 50000, '<a "' * 100000,
     "<table>" * 5000 + "<tr><td>c" * 20000, "<ul><li>" * 30000 + "</ul>" * 30000, "<" * 300000, "</p>" * 200000, "<!-" * 200000, "<li>x" * 100000, "<x y='>'>" * 100000],
)
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    main_blocks(Page(page), set())
    assert time.perf_counter() - began < 10
