import html
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pages, queries


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([1 << 25, 1, 0]))
def test_longest_common_subsequence(a, b, kept):
    """Whole and split in halves, an alignment is as long as the textbook's."""
    before, pages.KEPT = pages.KEPT, kept
    try:
        found = pages.common(a, b)
    finally:
        pages.KEPT = before
    assert all(a[i] == b[j] for i, j in found) and all(x < y and z < w for (x, z), (y, w) in zip(found, found[1:]))
    assert len(found) == longest(a, b)


def test_whole_table(spark, sf_dir):
    """Every given page marks its article: what is inside, without tags, is the text."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op12_page_differencing"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(html.unescape(re.sub("</?(p|br|h1)>", " ", article).replace("<b>", "")).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


LINES = [
    ("<p>one<br>two &lt;b&gt; &eacute;&nbsp;&#233;&#x41; x&amp</p>", [(1, "one"), (1, "two <b> é éA x&")]),
    ("<p>a<b>b</b>c <i>d\n e</i></p>f", [(1, "abc d e"), (1, "f")]),
    ("<p>x<p>y<ul><li>1<li>2</ul>z", [(1, "x"), (1, "y"), (1, "1"), (1, "2"), (1, "z")]),
    ("<script>var t = '</p>';</script>a<style>b{}</style><!-- c > --><title>d</title>e", [(1, "ae")]),
    ("<div class='ad-box'>buy<div>now</div></div><div id=cookieNotice>ok?</div>text", [(0, "buy"), (0, "now"), (0, "ok?"), (1, "text")]),
    ("<body class='has-sidebar'><div class='main-content sidebar-left'>t</div><div role=navigation>n</div>", [(1, "t"), (0, "n")]),
    ("<header>h</header><article><header><h1>Title</h1>by me</header><p>t</p><footer>f</footer></article>", [(0, "h"), (3, "Title"), (0, "by me"), (3, "t"), (0, "f")]),
    ("<main>m<article class=comment>c</article><section class='comments'><article>d</article></section></main>", [(2, "m"), (0, "c"), (0, "d")]),
    ("<form><p>mail</p><input></form><aside>s</aside><nav>n</nav><dialog>d</dialog><button>b</button>t", [(0, "mail"), (0, "s"), (0, "n"), (0, "d"), (1, "t")]),
    ("<article><p class=advert>buy<p>kept</article>", [(0, "buy"), (3, "kept")]),
    ("a < b and c > d <", [(1, "a < b and c > d <")]),
    ("<a title='x>y' href=\"/\">k</a><p hidden>no</p><p title=\"open>q", [(1, "k"), (0, "no"), (1, "q")]),
    ("</div></p>t</article>", [(1, "t")]),
    ("", []),
    ("<script>never ends", []),
]


def test_lines():
    for page, want in LINES:
        assert pages.lines_of(page) == want, page


def test_hostile_markup_takes_linear_time():
    for page in ('<a x="' * 100_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<!--" * 100_000, "<" * 200_000, "<p>" + "long " * 500_000):
        assert len(pages.lines_of(page)) <= 1


def brute(rows):
    """Neighbours in a sorted list, textbook alignment."""
    told = sorted((pages.key_of(u, i), pages.xxhash.xxh3_64_intdigest(h or "") - (1 << 63), i, u, pages.lines_of(h or "")) for i, u, h in rows)
    shared = [set() for _ in told]

    def size(lines, some=None):
        return sum(len(t) for k, (x, t) in enumerate(lines) if x and (some is None or k in some))

    for k in range(1, len(told)):
        host = told[k][0].split("\0")[0]
        if host and host == told[k - 1][0].split("\0")[0]:
            a, b = told[k - 1][4], told[k][4]
            both = pages.common([t for _, t in a], [t for _, t in b])
            assert len(both) == longest([t for _, t in a], [t for _, t in b])
            mine, other = {i for i, _ in both}, {j for _, j in both}
            if not any(size(x) and size(x, s) >= 0.9 * size(x) for x, s in ((a, mine), (b, other))):
                shared[k - 1] |= mine
                shared[k] |= other
    out = []
    for (_, _, i, u, lines), gone in zip(told, shared):
        best = max((x for x, _ in lines), default=0)
        text = " ".join(t for k, (x, t) in enumerate(lines) if x == best and best and (x == 3 or k not in gone))
        out.append((i, u, text, len(text)))
    return sorted(out, key=str)


def site():
    """A site without any markup that names parts: only differencing can tell its template."""
    r, rows = random.Random(3), []
    for i in range(60):
        host = ("a.example", "B.example", "b.example")[i % 3]
        body = "".join(f"<div>article {i} part {k} {r.random()}</div>" for k in range(6))
        top = f"<div>Welcome to {host.lower()}</div><div>Home</div><div>News</div>"
        rows.append((i, f"http://{host}/news/{i // 3:03}?x={i}", f"<body>{top}{body}<div>All rights reserved</div><div>Home</div></body>"))
    return rows


def rows_of(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_template_of_unmarked_pages_goes(spark, monkeypatch):
    rows = site()
    copy = (100, "http://a.example/news/000/copy", rows[0][2])
    rows += [copy, (101, "http://lone.example/x", rows[0][2]), (102, "http://lone.example/y", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = rows_of(pages.main_text(df))
    assert got == brute(rows)
    texts = {r[0]: r[2] for r in got}
    for i in range(3, 57):
        assert texts[i].startswith(f"article {i} part 0") and "Home" not in texts[i] and "reserved" not in texts[i]
    assert "article 0 part 5" in texts[101] and texts[101] == texts[102]  # copies don't delete each other
    for size in (1, 7):  # where ranges are cut changes nothing
        monkeypatch.setattr(pages, "RANGE", size)
        assert rows_of(pages.main_text(df.repartition(5))) == got


def test_hostile_rows(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 3)
    rows = [(1, None, "<p>a"), (2, "", "<p>a"), (None, "http://x.example/1", None), (3, "http://x.example/1", ""), (3, "http://x.example/1", "<p>t<p>u"), (3, "http://x.example/1", "<p>t<p>v")]
    rows += [(4, "not a url", "<nav>n</nav>"), (5, "http://x.example/2.html#top", "<p>" + "word " * 100_000), (6, "http://x.example/2/", "<p>t<p>w")] * 2
    rows += [(i, "http://hot.example/", f"<div>same</div><div>own {i}</div>") for i in range(50, 90)]  # one URL
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as `key`", "3 as `a.b`")
    assert rows_of(pages.main_text(df)) == brute(rows)
    assert pages.main_text(df.limit(0)).count() == 0
