"""Main text of pages, against texts written by hand and against pages put together from known parts."""

import random

import pytest

from stagesignal.llm import html

BODY = " ".join(f"word{k}" for k in range(120))
COLUMNS = "page_id long, url string, html string, text string, _host string, n_chars long"


def texts(spark, pages, host="http://a.example/"):
    """Text of each page, all on one host, with extra columns whose names clash."""
    rows = [(k, None if host is None else f"{host}{k}", p, "x", "y", 7) for k, p in enumerate(pages)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(n == len(t) for t, n in got.values())
    return [got[k][0] for k in range(len(pages))]


@pytest.mark.parametrize("page, wanted", [
    (f"<body><article><h1>Headline</h1><div class=content><p>{BODY}</div></article></body>", f"Headline\n{BODY}"),
    (f"<body><h1>Headline</h1><article><p>{BODY}</article><footer>Foot</footer></body>", f"Headline\n{BODY}"),
    (f"<main><div class=lead>The lead.</div><div class=body>{BODY}</div></main>", f"The lead.\n{BODY}"),
    (f"<div class=wrap><div class=lead>The lead.</div><div class=body>{BODY}</div><section>The end.</section></div>", f"The lead.\n{BODY}\nThe end."),
    (f"<article><p>{BODY}<section><p>The end.</section></article>", f"{BODY}\nThe end."),
    (f'<div id="content-share"><article><p>{BODY}</p></article><a href=/x>Share</a></div>', BODY),
    (f"<article><p class='side note'>A note.<div class='related-work'>Others did so.</div><div class=related><a href=/y>More</a></div><p>{BODY}</article>", f"A note.\nOthers did so.\n{BODY}"),
    (f"<article><div class='article-header'><h1>Headline</h1></div><p>{BODY}</article>", f"Headline\n{BODY}"),
    (f"<article><p>A short one.</article><section id=comments><article>{BODY}</article></section>", "A short one."),
    (f"<div class=links><a href=/a>One link</a></div><div class=text><p>{BODY}</div>", BODY),
    (f"<article><p>{BODY} <span class=ad>Buy</span> more.</article>", f"{BODY} more."),
    (f"<div class=ad>{BODY}</div><article><p>A short one.</article>", "A short one."),
    (f"<div class=share><p>{BODY}</p><p>More.</p></div>", f"{BODY}\nMore."),
    (f"<div class='sidebar'><h2>Side</h2>{BODY}</div><main><p>A short one.</main>", "A short one."),
    (f"<article class=a><p>First part.</article><article class=b><p>{BODY}</article>", f"First part.\n{BODY}"),
    ("", ""), (None, ""), ("<p>loose &lt;text&gt;", "loose <text>"), ("</div></p><p>stray", "stray"),
])
def test_nothing_of_an_article_is_lost(spark, page, wanted):
    assert texts(spark, [page] * 3) == [wanted] * 3
    assert texts(spark, [page], None) == [wanted]


def test_host_with_two_templates(spark):
    one = [f"<body><div class=top>Site {k}</div><div class=story><h2>Story {k}</h2><p>{BODY}</div></body>" for k in range(3)]
    two = [f"<body><article><h1>Piece {k}</h1><p>{BODY}</article><div class=story>Teaser</div></body>" for k in range(6)]
    got = texts(spark, one + two)
    assert got[3:] == [f"Piece {k}\n{BODY}" for k in range(6)]
    assert all(f"Story {k}\n{BODY}" in t for k, t in enumerate(got[:3]))


def test_consensus_drops_what_most_pages_of_a_host_have_outside(spark):
    page = "<body><div class=l><a href=/>{0}</a></div>{1}<div class=story><p>%s</div></body>" % BODY
    got = texts(spark, [page.format("Home", "")] * 5 + [page.format("Home", "<div class=welcome>Welcome to us.</div>")])
    assert got == [BODY] * 6


def test_large_and_deep_pages(spark):
    paragraphs = [f"Paragraph {k} of a page." for k in range(200_000)]
    large = "<article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>"
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    assert len(large) > 5_000_000
    assert texts(spark, [large, deep]) == ["\n".join(paragraphs), "deep"]


def made(rng, depth, want):
    """Markup and, in want, the blocks that are article: a random tree of containers with boilerplate in between."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.5 or depth > 4:
            text = f"Text {rng.randint(0, 10**6)} of it."
            want.append(text)
            out.append(f"<p>{text.replace(' ', rng.choice([' ', chr(10), '  ']))}</p>")
        elif kind < 0.7:
            out.append(rng.choice(["<nav><a href=/>Menu</a></nav>", "<div class=ad>Buy</div>", "<aside>Aside</aside>", "<form>Name</form>", "<!-- no -->", "<script>x('</p>')</script>", "<div class='cookie-notice'>We use</div>"]))
        else:
            tag = rng.choice(["div", "section", "div class=body", "div class=c7"])
            out.append(f"<{tag}>{made(rng, depth + 1, want)}</{tag.split()[0]}>")
    return "".join(out)


def test_nested_pages_against_their_parts(spark):
    rng, pages, wanted = random.Random(3), [], []
    for k in range(120):
        want = [f"Head {k}", *[f"Body {j} of the page." for j in range(6)]]
        inner = made(rng, 0, want)
        pages.append(f"<html><body><nav>Menu</nav><{['article', 'main'][k % 2]}><h1>Head {k}</h1>" + "".join(f"<p>{w}" for w in want[1:7]) + inner + f"</{['article', 'main'][k % 2]}><footer>Foot</footer></body></html>")
        wanted.append("\n".join(want))
    assert texts(spark, pages) == wanted
