"""Main text of web pages by consensus host paths.

A page's blocks of text (menus, adverts and the like left out) are weighed, links counting little, and its containers
scored: what the page itself marks as article or main, if that holds most of the text, with a headline above it; or else
the smallest container beside which there are only links. A page votes for the generalised tag-class paths of these.
Votes are added up per host in Spark, and every page is then extracted anew by its host's winning paths: the first one
that holds all that the page marks as its article, or most of the text of a page that marks none. A page without such
a path uses its own.

A part whose class or id has the name of boilerplate is left out, unless it is a wrapper (it holds most of the page's
text and its article, main or headline; or nearly all text of a page without any of these; comments: all of it). The same
holds for forms, asides, headers, footers, dialogs and objects. Within the article a part also stays that is no list of links, if its
name is a vague one, or has a word of boilerplate as a part of another name (market-share). Paragraphs and headings are
not left out by vague names.

Defined cases: null html is empty and gives an empty text; pages with a null or odd url share the host ""; unclosed
and stray tags are tolerated; text outside any tag belongs to the root; containers nested more than DEEPEST deep share
the path of the one at that depth; repeated rows are extracted alike, each counted in the vote; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stagesignal.llm.common import cut

#: Comments, declarations, elements whose content is no markup, and tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>",
    re.IGNORECASE | re.DOTALL,
)
ATTR = re.compile(r"""([a-z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp select small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these closes an open one of the same set.
CLOSES = {t: frozenset(group.split()) for group in ("p h1 h2 h3 h4 h5 h6", "li", "dt dd", "tr", "td th", "option") for t in group.split()}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Parts of a page that are no article.
NOT_TEXT = frozenset("head nav button select option menu audio video canvas map".split())
NOT_ROLES = frozenset("navigation search alert alertdialog menu menubar".split())
#: Those that some pages wrap around all they have.
AROUND = frozenset("form aside footer header dialog object".split())
AROUND_ROLES = frozenset("banner contentinfo complementary form dialog".split())


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.IGNORECASE)


#: Names of parts that are no article: reader comments, plain names of boilerplate, and names that articles use as well.
ELEMENT, COMMENTS, PLAIN, VAGUE = 4, 3, 2, 1
PLAIN_WORDS = r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|nav|navbar|navigation|breadcrumbs?|sidebar|share|sharing|social|subscribe|newsletter|popup|modal|pagination|pager"
NAMES = (
    (COMMENTS, _names(r"comments?|commentlist|disqus|replies|respond")),
    (PLAIN, _names(PLAIN_WORDS)),
    (VAGUE, _names(r"banner|menu|side|footer|header|masthead|related|recommended|overlay|widget|toolbar")),
)
#: Words that may stand before and after a plain name without another meaning: post-share and ad-box, not market-share.
BEFORE, AFTER = (
    r"article|body|bottom|content|entry|footer|header|in|inline|js|left|main|mobile|page|post|right|section|site|story|top",
    r"area|banner|bar|block|bottom|box|button|buttons|container|content|footer|form|header|icon|icons|inline|inner|item|items|label|left|link|links|list|message|right|row|section|sign-?up|slot|text|top|unit|widget|wrap|wrapper|\d+",
)
OWN = re.compile(rf"(?:^|\s)(?:(?:{BEFORE})[_-])*(?:{PLAIN_WORDS})(?:[_-](?:{AFTER}|{PLAIN_WORDS}))*(?:$|\s)", re.IGNORECASE)
#: Containers in a path, and parts with names of boilerplate within each other, at most.
DEEPEST, NESTED = 64, 8
#: Winning paths kept per host, parts that a large table of hosts is salted into, and hosts whose paths may be broadcast.
WINNERS, SALTS, MOST_HOSTS = 8, 32, 50_000


@dataclass
class Part:
    """An element whose name is that of boilerplate."""

    kind: int
    inside: bool  # lies in an article or main
    own: bool = True  # its name means nothing else
    holds: bool = False  # an article, a main or a headline
    size: int = 0
    linked: int = 0

    def stays(self, total: int, marked: bool) -> bool:
        """total: text of the page; marked: whether it has an article, a main or a headline anywhere. Within an article a part
        needs more than a word in its name to go: a name of its own, or links for most of its text."""
        if self.kind == COMMENTS:
            return self.size == total
        wrapper = 2 * self.size >= total if self.holds else 10 * self.size >= 9 * total and not marked
        return wrapper or (self.kind == VAGUE or self.kind == PLAIN and not self.own) and self.inside and 2 * self.linked < self.size


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)} if text and ("=" in text or "hidden" in text) else {}


def _step(tag: str, attrs: dict[str, str]) -> str:
    """tag.class of a container, digits generalised."""
    names = sorted(set(re.sub(r"\d+", "#", attrs.get("class", "")).lower().replace("/", "_").split()))
    return ".".join([tag, *names])


def _named(tag: str, attrs: dict[str, str]) -> tuple[int, bool]:
    """The kind of boilerplate that an element's class and id name, or 0, and whether a name means nothing else."""
    if not ("class" in attrs or "id" in attrs) or tag in ("html", "body", "article", "main"):
        return 0, True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    kind = next((k for k, pattern in NAMES if pattern.search(names)), 0)
    text = tag in HEADINGS or tag in INLINE or tag in ("p", "li", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "tr")
    return 0 if tag in HEADINGS and kind == PLAIN or text and kind == VAGUE else kind, bool(OWN.search(names))


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(container path, text, characters of it in links) of each block of text, in page order, without boilerplate."""
    page = page or ""
    raw: list[tuple[str, str, int, tuple[int, ...]]] = []
    parts: list[Part] = []
    stack: list[tuple] = []  # tag, and what it is in: path, depth, whether left out, whether a link, named parts
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack
    barriers: list[int] = []  # places of elements beyond which none is closed
    marks: list[tuple[int, ...]] = []  # named parts around each article, main and headline
    top = ("", 0, False, False, ())
    path, depth, skip, link, names = top
    held: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                raw.append((path, text, min(linked, len(text)), names))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal path, depth, skip, link, names
        if any(t[0] not in INLINE for t in stack[to:]):
            flush()
        for t in stack[to:]:
            places[t[0]].pop()
        del stack[to:]
        while barriers and barriers[-1] >= to:
            barriers.pop()
        path, depth, skip, link, names = stack[-1][1:] if stack else top

    for m in TOKEN.finditer(page):
        if m.start() > at and not skip:
            held.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not skip:
                held.append(" ")
                if tag == "hr":
                    flush()
            continue
        same = CLOSES.get(tag)
        if same or tag in BLOCKS_CLOSE_P:
            closable = (*(same or ()), *(("p",) if tag in BLOCKS_CLOSE_P else ()))
            k = max((places[t][-1] for t in closable if places[t]), default=-1)
            if k >= 0 and (not barriers or k >= barriers[-1]):
                pop(k)
        if tag not in INLINE:
            flush()
        attrs = _attrs(m["attrs"])
        inside = "/article" in path or "/main" in path
        now = (path, depth, skip, link, names)
        if not skip:
            skip = tag in NOT_TEXT
            around, kind, own = tag in AROUND and not (tag == "header" and inside), 0, True
            if attrs and tag not in ("html", "body", "article", "main"):
                role = attrs.get("role", "").lower()
                skip = skip or "hidden" in attrs or role in NOT_ROLES or bool(HIDDEN.search(attrs.get("style", "")))
                around = around or role in AROUND_ROLES
                kind, own = (0, True) if skip else _named(tag, attrs)
            if around and not skip:
                skip = len(names) >= NESTED
                kind = ELEMENT
            if kind and tag in INLINE:
                skip = True
            elif kind and not skip and len(names) < NESTED:
                flush()
                names = (*names, len(parts))
                parts.append(Part(kind, inside, own))
        if not skip and tag in ("article", "main", "h1"):
            marks.append(names)
        if (tag in CONTAINERS or tag == "h1") and depth < DEEPEST:
            path, depth = f"{path}/{_step(tag, attrs)}", depth + 1
        link = link or tag == "a"
        # Other inline elements change nothing, so they need not be kept open; <a/> opens nothing, <div/> does.
        if tag in INLINE and (CLOSED.search(m["attrs"]) or (path, depth, skip, link, names) == now):
            path, depth, skip, link, names = now
        else:
            places[tag].append(len(stack))
            if tag in CONTAINERS or tag in ("ul", "ol", "table", "dl"):
                barriers.append(len(stack))
            stack.append((tag, path, depth, skip, link, names))
    if not skip:
        held.append(page[at:])
    flush()
    # First elements around others: what goes with them counts no more. Then parts by their names.
    gone: set[int] = set()
    for kinds in ((ELEMENT,), (COMMENTS, PLAIN, VAGUE)):
        left = [(len(text), n, within) for _, text, n, within in raw if not gone.intersection(within)]
        held = [names for names in marks if not gone.intersection(names)]
        for part in parts:
            part.size = part.linked = 0
            part.holds = False
        for size, n, within in left:
            for k in within:
                parts[k].size += size
                parts[k].linked += n
        for names in held:
            for k in names:
                parts[k].holds = True
        total = sum(size for size, _, _ in left)
        gone |= {k for k, part in enumerate(parts) if part.kind in kinds and not part.stays(total, bool(held))}
    return [(p, text, n) for p, text, n, within in raw if not gone.intersection(within)]


Blocks = list[tuple[str, str, int]]


def _weight(found: Blocks) -> float:
    return sum(len(text) - 0.9 * linked for _, text, linked in found)


def _links_only(found: Blocks) -> bool:
    return all(2 * linked >= len(text) for _, text, linked in found)


def _outer(path: str, tag: str) -> str | None:
    """The outermost container of that tag that path lies in."""
    steps = path.split("/")
    k = next((k for k, s in enumerate(steps) if s.partition(".")[0] == tag), None)
    return None if k is None else "/".join(steps[: k + 1])


def _under(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/") or not container


def _marked(found: Blocks, tag: str) -> list[str]:
    """The outermost containers of that tag, those that hold nothing but links left out if others do not."""
    by: dict[str, Blocks] = defaultdict(list)
    for b in found:
        if p := _outer(b[0], tag):
            by[p].append(b)
    return sorted(p for p in by if not _links_only(by[p])) or sorted(by)


def chosen(found: Blocks) -> tuple[list[str], bool]:
    """The containers that hold a page's article by the page alone, and whether the page marks them as such."""
    total = _weight(found)
    if not total:
        return [""], False
    in_ = lambda paths: [b for b in found if any(_under(b[0], p) for p in paths)]
    for tag in ("main", "article"):
        paths = _marked(found, tag)
        held = in_(paths) if paths else []
        if not paths or 2 * _weight(held) < total:
            continue
        if tag == "main":
            articles = _marked(held, "article")
            if articles and _links_only([b for b in held if not any(_under(b[0], p) for p in articles)]):
                return articles, True
            return paths, True
        if not any(_outer(b[0], "h1") for b in held):  # a headline above the article
            paths = paths + sorted({h for b in found if (h := _outer(b[0], "h1"))})
        return paths, True
    node = at = ""
    under = found
    while True:
        inner: dict[str, Blocks] = defaultdict(list)
        rest = []
        for b in under:
            step = b[0][len(at) + 1 :].partition("/")[0] if b[0] != at else ""
            (inner[f"{at}/{step}"] if step else rest).append(b)
        if not inner:
            return [node], False
        at = max(inner, key=lambda p: (_weight(inner[p]), p))
        rest += [b for p, bs in inner.items() if p != at for b in bs]
        if not _links_only(rest):
            return [node], False
        node, under = at if rest else node, inner[at]


def votes(page: str | None) -> dict[str, int]:
    """Votes of a page for container paths, 1000 in all: for those that hold its article, by their share of its text."""
    found = blocks(page)
    own, _ = chosen(found)
    held = {p: _weight([b for b in found if _under(b[0], p)]) for p in own}
    total = sum(held.values())
    return {p: round(1000 * w / total) for p, w in held.items()} if total else {}


def extract(page: str | None, winners: list[str]) -> str:
    """The page's text by the first winning path that holds its article, or by its own paths where none does."""
    found = blocks(page)
    own, marked = chosen(found)
    heads = [p for p in own if p.rpartition("/")[2].partition(".")[0] == "h1"]
    total, use = _weight(found), own
    for w in winners:
        if marked:
            fits = (_outer(w, "article") or _outer(w, "main")) and all(_under(p, w) for p in own if p not in heads)
        else:
            fits = 2 * _weight([b for b in found if _under(b[0], w)]) >= total
        if fits:
            use = [w, *heads]
            break
    return "\n".join(text for path, text, _ in found if any(_under(path, p) for p in use))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for h, page in zip(batch["host"], batch["html"]):
            for p, n in votes(page).items():
                sums[h, p] += n
        yield pd.DataFrame([(h, p, n) for (h, p), n in sums.items()], columns=["host", "path", "n"]).astype({"n": "int64"})


def winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, paths: the WINNERS container paths that the pages of a host vote for most, in that order."""
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    sums = rows.mapInPandas(_vote, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    best = sums.withColumn("k", place).where(F.col("k") <= WINNERS)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))


@F.pandas_udf(T.StringType())
def _extracted(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([extract(h, p.tolist() if p is not None else []) for h, p in zip(pages, paths)], index=pages.index, dtype=object)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars, and host_path, its host's first path. Pages are read twice rather than shuffled
    while the hosts are few; beyond that, the pages of a host are dealt over SALTS parts."""
    best = cut(winners(pages, url_col, html_col)).select(F.col("host").alias("_h"), F.col("paths").alias("_paths"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(F.col(url_col)).alias("_host"))
    on = F.col("_host") == F.col("_h")
    if best.count() <= MOST_HOSTS:
        best = F.broadcast(best)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)))
        best = best.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_s"))
    rows = rows.join(best, on, "left").withColumn("_text", _extracted("_html", "_paths"))
    return rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"),
                       F.length("_text").cast("long").alias("n_chars"), F.get("_paths", F.lit(0)).alias("host_path"))
