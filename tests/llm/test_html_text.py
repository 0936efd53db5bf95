import random

import pytest
from pyspark.sql import functions as F

from talweg.llm import html_text as H
from talweg.llm.queries import op8_html_text

SCHEMA = "page_id long, url string, html string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar nav-open"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use <b>cookies</b></div><!-- <p>hidden</p> -->
<main><article><header><h1>The &amp; title</h1><p>By me</p></header><p>First&nbsp;line<br>goes   on<p>Second <b>bold</b>,<i>it</i>
<ul><li>one<li>two</ul><aside>Note</aside><div class="ad">Buy</div><form><p>Your mail</p></form>
<pre>a
  b</pre><table><tr><td>x<td>y</tr><tr><td>z</table><p hidden>no</p><div style="display: none">no</div>
<section class="comments"><article><p>Reader says</p></article></section></article></main>
<div id="sidebar"><p>Side</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "The & title\nBy me\nFirst line goes on\nSecond bold,it\none\ntwo\na b\nx y\nz"


def kept(page):
    return "\n".join(t for t, where in H.lines_of(page) if where != H.NAMED)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_structure():
    assert kept(PAGE) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;words&gt; 1 < 2", "plain <words> 1 < 2"),
        ("<p>cut off <b>here</b> <a hre", "cut off here"),
        ("<p>a<!-- never ends <p>b", "a"),
        ("<script>x</script><p>a</p><script>never ends <p>b", "a"),
        ('<div class="post"><p title="a > b">text</p></div><div class="RelatedPosts"><p>more</p></div>', "text"),
        ("<article><p><b>open<br><p>next</b> on</p></article><p>after</p>", "open\nnext on\nafter"),
        ("<p>&am", "&am"),
        ("<ul><li><a href=x>menu</a></li></ul><p>body</p>", "body"),
        ('<div class="topbar"><p>no</p></div><article><div class="header"><h1>yes</h1></div></article>', "yes"),
        ("<article><p>if <math><mi>x</mi> = 1</math> then <object>y</object></p></article>", "if x = 1 then y"),
        ('<article><section class="alert-systems"><p>on alerts</p></section><section id="comments-on-the-law"><p>law</p></section></article>', "on alerts\nlaw"),
        ('<article><header><h1>T</h1><p>standfirst</p></header><div class="ad-box"><p>buy</p></div><p>a<button>ok</button> b</p></article>', "T\nstandfirst\na b"),
    ],
)
def test_small_pages(page, text):
    assert kept(page) == text


def brute_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(400):
        a, b = (rng.choices(range(rng.randint(1, 9)), k=rng.randint(0, 30)) for _ in range(2))
        found = sorted(H.common_lines(a, b))
        assert len(found) == brute_lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)  # in order


def test_differencing(spark):
    shell = "<div><p>Welcome to the site</p></div>{}<div><p>All rights reserved</p></div>"
    pages = [
        (0, "http://H.example/a/1", shell.format("<p>one</p><p>two</p>")),
        (1, "http://h.example/a/2", shell.format("<p>three</p>")),
        (2, "http://h.example/b/9", shell.format("<article><p>All rights reserved</p></article>")),
        (3, "http://other.example/a/1", shell.format("<p>alone</p>")),
        (4, None, shell.format("<p>no url</p>")),
        (5, "http://copy.example/x", shell.format("<p>same</p>")),
        (6, "http://copy.example/y", shell.format("<p>same</p>")),
        (7, "no address", None),
        (None, "http://h.example/a/1", shell.format("<p>repeated</p>")),
    ]
    df = spark.createDataFrame(pages, SCHEMA).withColumn("uid", F.lit("clash")).withColumn("blocks", F.lit(1)).repartition(4)
    got = texts(H.main_text(df))
    whole = "Welcome to the site\n{}\nAll rights reserved"
    assert got == {0: "one\ntwo", 1: "three", 2: "All rights reserved", 3: whole.format("alone"), 4: whole.format("no url"), 5: whole.format("same"), 6: whole.format("same"), 7: "", None: "repeated"}
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_site(rng, pages, passage):
    """{url: (html, text)} of a site whose pages say nothing about what their elements are."""
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=n)) + f" {rng.randrange(10**9)}"
    menu, foot = [words(2) for _ in range(6)], [words(8), words(5)]
    out = {}
    for k in range(pages):
        own = [words(rng.randint(20, 60)) for _ in range(rng.randint(3, 8))]
        if k % 5 == 0:
            own.insert(1, passage)  # pages far from each other quote the same
        body = "".join(f"<div>{x}</div>" for x in [*menu, *own, *foot])
        out[f"http://plain.example/{k // 10}/{k:04d}"] = f"<html><body><div>{body}</div></body></html>", "\n".join(own)
    return out


def test_differencing_alone_cleans_a_site_without_names(spark):
    rng = random.Random(6)
    site = plain_site(rng, 60, "a passage " * 30 + "that many quote")
    copies = {f"{url}?ref={k}": site[url] for k, url in enumerate(list(site)[7:10])}
    rows = [(i, url, page) for i, (url, (page, _)) in enumerate([*site.items(), *copies.items()])]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = {**site, **copies}
    assert len(got) == 63 and all(r.text == " ".join(want[r.url][1].split(" ")) for r in got)
    assert sum(r.n_shared for r in got) == 63 * 8 and sum(r.n_named for r in got) == 0


def test_quotations_by_neighbours_stay(spark):
    rng = random.Random(8)
    site = plain_site(rng, 40, "a passage " * 30 + "that many quote")
    urls = sorted(site)
    quoted = "a long statement of the board that four neighbouring pages print in full"
    rows = []
    for k, url in enumerate(urls):
        page, text = site[url]
        if 10 <= k < 15:
            page, text = page.replace("</div></div>", f"</div><div>{quoted}</div></div>", 1), None
        rows.append((k, url, page, text))
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame([r[:3] for r in rows], SCHEMA).repartition(3)).collect()}
    assert all(quoted in got[k] for k in range(10, 15))
    assert all(got[k] == " ".join(text.split(" ")) for k, _, _, text in rows if text)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_driver_pages_without_article_tags(spark, scale):
    pages = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    truth, got = texts(H.main_text(pages)), texts(H.main_text(bare))
    assert got == truth


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    keys = sorted({(rng.choice("ab"), "/" + "".join(rng.choices("xyz", k=rng.randint(0, 5)))) for _ in range(150)})
    rows = [(i, h, p, i) for i, (h, p) in enumerate(keys)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            frame = spark.createDataFrame(rows, "uid long, host string, path string, value long").repartition(3)
            found.append({r.uid: sorted(r.others) for r in H.neighbours(frame).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: [j for j in range(max(0, i - 2), i + 3) if j != i and j < len(rows) and rows[j][1] == rows[i][1]] for i in range(len(rows))}
    assert found[0] == found[1] == found[2] == want


def test_query_on_driver_table(spark):
    import html
    import re

    where = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    rows = op8_html_text(spark, where).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].html.partition("<article>")[2].partition("</article>")[0]
        parts = [html.unescape(re.sub(r"<[^>]*(>|$)", " ", p)).split() for p in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(" ".join(p) for p in parts if p)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
