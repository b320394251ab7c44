"""Articles within forms and parts with other names, and pages that are nested without end."""

import random
import time

import pytest

from stagesignal.llm import html

BODY = "The harvest was late this year, and the barns stood empty until the first frost came down from the hills."
MORE = "Nobody in the valley had seen such a summer before, said the miller."


def text(page):
    return html.extract(page, [])


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm"><div id="content"><h1>Head</h1><p>{BODY}</p><p>{MORE}</p></div></form>',
    f"<body><form action='/'><main><article><h1>Head</h1><p>{BODY}</p><p>{MORE}</p></article></main></form></body>",
    f"<aside><h1>Head</h1><p>{BODY}</p><p>{MORE}</p></aside>",
    f'<div role="dialog"><article><h1>Head</h1><p>{BODY}</p><p>{MORE}</p></article></div>',
    f'<form><nav>Home</nav><header>Site name</header><article><h1>Head</h1><p>{BODY}</p><p>{MORE}</p></article><footer>Imprint</footer><form>Search</form></form>',
])
def test_what_wraps_a_page_is_no_boilerplate(page):
    assert text(page) == f"Head\n{BODY}\n{MORE}"


def test_forms_beside_the_article_go():
    page = f"<article><h1>Head</h1><p>{BODY}</p><form><p>Your name and address, please, for our letter</p><button>Send</button></form><p>{MORE}</p></article><form>Search</form><aside><article><h1>Other</h1>Elsewhere</article></aside>"
    assert text(page) == f"Head\n{BODY}\n{MORE}"


@pytest.mark.parametrize(("name", "stays"), [("market-share", True), ("social-impact", True), ("notice-of-award", True), ("newsletter-history", True), ("share", False), ("ad-box", False), ("post-share", False), ("newsletter-signup", False), ("ads ad-slot-3", False)])
def test_names_within_an_article(name, stays):
    part = "Firm A holds 40 per cent."
    page = f'<article><h1>Head</h1><p>{BODY}</p><div class="{name}"><p>{part}</p></div><p>{MORE}</p></article>'
    assert text(page) == "\n".join(["Head", BODY, *([part] if stays else []), MORE])
    links = page.replace(part, '<a href="/">one link</a> <a href="/">another link</a>')
    assert text(links) == f"Head\n{BODY}\n{MORE}"


def test_buttons_and_hidden_parts():
    assert text(f'<article><p>{BODY} <button>x</button> more</p><div style="display: none">gone</div><p style="Visibility:hidden">gone</p></article>') == f"{BODY} more"


@pytest.mark.parametrize("page", ["<blockquote>" * 80_000 + BODY, "<p><td>" + "<blockquote>" * 80_000 + BODY, "<!" * 500_000, "<script " * 130_000, "<p>" * 300_000 + BODY, '<a "' * 250_000, "<form>" * 150_000 + BODY, "<li><b>" * 140_000 + BODY])
def test_pages_of_a_megabyte_take_linear_time(page):
    start = time.time()
    html.extract(page, [])
    html.votes(page)
    assert time.time() - start < 10


def test_random_pages_lose_nothing_of_the_article():
    """Paragraphs within nested wrappers and parts whose names only hold a word of boilerplate, in page order."""
    for seed in range(60):
        draw = random.Random(seed)
        told = []

        def inner(depth):
            out = ""
            for _ in range(draw.randint(1, 3)):
                if depth and draw.random() < 0.6:
                    name = draw.choice(["market-share", "ad-hoc-notes", "social-impact", "notice-of-award", "chapter", "share-of-voice"])
                    out += f'<{(tag := draw.choice(["div", "section"]))} class="{name}">{inner(depth - 1)}</{tag}>'
                else:
                    told.append(f"Sentence {len(told)} of {seed} tells of the harvest and the hills.")
                    out += f"<p>{told[-1]}</p>"
            return out

        body = f"<article><h1>Head</h1>{inner(3)}</article>"
        for tag in draw.sample(["form", "div", "main", "section"], draw.randint(0, 3)):
            body = f"<{tag}>{body}</{tag}>"
        assert text(f"<body><nav><a href='/'>Home</a></nav>{body}<footer>Imprint</footer></body>") == "\n".join(["Head", *told]), seed
