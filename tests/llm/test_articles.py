"""Main texts: the given pages against a plain reading of their one layout, and written pages of others."""

import html
import re

import pytest

from passagework.llm import articles, queries

SCHEMA = "page_id long, url string, html string"


def plainly(source):
    """The given tables' layout: everything between the article's tags, block tags as ends of blocks."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    pieces = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in pieces)
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    at = f"/root/testdata/{sf}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    rows = queries.queries()["op11_html_extraction"](spark, at).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"]
        assert r["text"] == plainly(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"])


def article(words, n=4):
    return "".join(f"<p>{words} sentence {i}, with some more words to read.</p>" for i in range(n))


def text(source, paths=()):
    return articles.main_text(source, list(paths))


def test_what_is_no_main_text():
    page = f"""<!doctype html><html><head><title>T &lt; U</title><style>p > b {{}}</style></head><body class="comments-open">
      <header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
      <div id=cookie-notice><p>{"We use cookies. " * 40}</p></div>
      <main><article class="post post-17"><header><h1>A &amp; B</h1><p>by someone</p></header>{article("First")}
        <form><p>{"Sign up now. " * 40}</p></form><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
        <div class="ad-slot ad"><p>Buy.</p></div><p hidden>no</p><ul><li><a href=x>One link</a><li>kept item</ul>
        <p>a&nbsp;b &lt;c&gt; &#233;&copy;<br>d <b>e</b>f</p></article>
      <section id="comments"><article class="comment"><p>{"I disagree. " * 90}</p></article></section></main>
      <aside><p>Side</p></aside><footer>Foot</footer></body></html>"""
    want = ["A & B", *(f"First sentence {i}, with some more words to read." for i in range(4)), "One link", "kept item", "a b <c> é© d ef"]
    assert text(page) == "\n".join(want)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""), ("<", "<"), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("a < b and c > d", "a < b and c > d"), ("<div title=\"x > y\">in</div>", "in"),
        ("<div class='x>in</div>", "in"), ("<p>one</div> two", "one\ntwo"), ("<script>never closed <p>x", ""), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("&amp;lt; &unknown; &am", "&lt; &unknown; &am"),
    ],
)
def test_odd_markup(source, want):
    assert text(source) == want


def test_links_only_are_a_menu():
    page = f"<body><div><ul>{'<li><a href=x>A menu entry of some length</a></li>' * 5}</ul>{article('Body')}</div></body>"
    assert text(page).startswith("Body sentence 0")


def test_deep_and_long():
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = " ".join(f"w{i}" for i in range(300_000))
    assert text(f"<article><p>{long}</p></article>") == long


def pages_of_a_host():
    """A host whose pages keep the article in div.body-<n>; on some an unnamed box holds more text."""
    rows = []
    for i in range(12):
        box = f"<div class='zone'><p>{'Most read here today. ' * 60}</p></div>" if i < 4 else ""
        rows.append((i, f"https://User@News.example.org:80/{i}", f"<body><div class='body-{i}'>{article('News', 3)}</div>{box}</body>"))
    return rows


@pytest.mark.parametrize("few_hosts", [articles.FEW_HOSTS, 0])
def test_consensus_of_the_host(spark, few_hosts):
    rows = pages_of_a_host() + [(20, "https://other.example.org/", "<div><p>Other words.</p></div>"), (21, None, None), (22, "no url", "<p>Alone.</p>"), (22, "no url", "<p>Alone.</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", host string, n int")
    found = sorted((r["page_id"], r["text"]) for r in articles.extracted(df, few_hosts).collect())
    news = "\n".join(f"News sentence {i}, with some more words to read." for i in range(3))
    assert found == [*((i, news) for i in range(12)), (20, "Other words."), (21, ""), (22, "Alone."), (22, "Alone.")]
    assert "Most read" in text(rows[0][2])  # which the page alone would give
    best = {r["host"]: r["paths"] for r in articles.host_paths(df).collect()}["news.example.org"]
    assert best[0]["path"] == "body>div.body-#"


def test_empty_table(spark):
    assert articles.digest(spark.createDataFrame([], SCHEMA)).collect() == []
