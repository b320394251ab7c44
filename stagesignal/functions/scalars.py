"""Column functions on run ids, text, URLs, hashes and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the token profiles.
ACTIONABLE_STOP = (
    "a an the and or of in to for is are was were he she they his her their it this that with on at by from as has have had not but also been "
    "which who when where what how its be do does did"
).split()
ITEM_STOP = "a an the and or of in to for is are was were he she they his her their it this that".split()
SEARCH_STOP = ACTIONABLE_STOP + "i my me we our you your can will would should may into than then so if about more most other".split()

# Phrases of a generic query, parts of hosts by category in order, and certainty wording.
GENERIC_PHRASES = (
    "best books", "best practices", "how to", "what is", "overview of", "introduction to", "top 10", "isbn", "pdf", "course", "tutorial", "guide to",
    "list of", "vs ", "versus", "review of", "definition of", "examples of", "methods for", "strategies for", "techniques for", "workbook", "textbook", "syllabus",
)
URL_RULES = (
    ("retail_books", ("amazon", "dangdang", "book", "goodreads", "isbn")), ("video", ("youtube", "bilibili", "vimeo")), ("encyclopedia", ("wikipedia", "wiki")),
    ("academic", ("edu", "ac.", "arxiv", "springer", "ieee", "acm.org", "nih.gov", "pubmed")), ("forum", ("reddit", "zhihu", "quora", "stackoverflow")),
    ("course_platform", ("coursera", "udemy", "edx", "skillshare", "khan")), ("gov", ("gov", "who.int", "cdc.gov")), ("blog", ("medium.com", "blog", "substack")),
)
STRONG = (
    "only|perfectly|clearly|unambiguously|definitively|strongest|aligns perfectly|no other|exclusive|unmistakably|obviously|most closely|best match|sole|decisively"
)
HEDGED = (
    "might|could|possibly|perhaps|unclear|ambiguous|either|both|somewhat|partially|suggests?|appears?|seems?|less clear|harder to|not definitive|no single"
)
CAPS = {"plan": 4000, "search": 3500, "compress": 6000, "write": 8000}

RUN_ID = r"^(?:pilot|ablation_([A-Za-z0-9_]+?))_task([0-9]+)_([A-Za-z0-9]+)_seed([0-9]+)$"


def parse_run_id(c: Column, strict: bool = False) -> Column:
    """struct(valid, prefix, condition, taskid, userid, seed); strict: an unparsable id is an error."""
    part = lambda k: F.nullif(F.regexp_extract(c, RUN_ID, k), F.lit(""))
    good = F.coalesce(c.rlike(RUN_ID), F.lit(False))
    valid = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad run id: "), F.coalesce(c, F.lit("null")))).cast("boolean")) if strict else good
    return F.struct(valid.alias("valid"), F.when(good, F.substring_index(c, "_", 1)).alias("prefix"), part(1).alias("condition"), part(2).cast("long").alias("taskid"), part(3).alias("userid"), part(4).cast("long").alias("seed"))


def canonical_run_id(c: Column) -> Column:
    """ablation_<condition>_task... as pilot_task..., so that conditions pair."""
    return F.regexp_replace(c, r"^ablation_[A-Za-z0-9_]+?_task", "pilot_task")


#: Letters and digits with one inner apostrophe or hyphen.
WORD = r"[A-Za-z0-9]+(?:['\u2019-][A-Za-z0-9]+)?"


def tokens(c: Column, profile: str = "plain") -> Column:
    """Lower-case [a-z0-9]+ tokens. `actionable` and `search`: without stop words (a longer list for search) and of three
    letters or more; `item`: without a short stop list; `words`: with one inner apostrophe (straight or curly) or hyphen."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if profile == "words":
        return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)
    found = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    if profile in ("actionable", "search"):
        stop = ACTIONABLE_STOP if profile == "actionable" else SEARCH_STOP
        return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(stop))
    if profile == "item":
        return F.filter(found, lambda t: ~t.isin(ITEM_STOP))
    return found


def jaccard(a: Column, b: Column, empty: float | None = 0.0, digits: int | None = None) -> Column:
    """Overlap of two arrays as sets; empty is the value for two empty ones."""
    union = F.size(F.array_union(a, b))
    value = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty).cast("double"))
    return value if digits is None else F.round(value, digits)


def token_entropy(toks: Column) -> Column:
    """Shannon entropy of an array's values, in bits."""
    n = F.size(toks)
    # The log2 of a count is the sum of the logs of (k / (k - 1)) up to it, so runs of the sorted array need no second pass:
    # the k-th of equal values adds k log2 k - (k - 1) log2 (k - 1).
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(1)
        more = F.when(run > 1, run * F.log2(run) - (run - 1) * F.log2(F.greatest(run - 1, F.lit(1)))).otherwise(0.0)
        return F.struct(t.alias("last"), run.alias("run"), (acc["sum"] + more).alias("sum"))

    return F.when(n > 0, F.log2(n) - F.aggregate(F.array_sort(toks), start, step)["sum"] / n).otherwise(0.0)


def type_token_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.array_distinct(toks)) / F.size(toks)).otherwise(0.0)


def retention(source: Column, text: Column) -> Column:
    """Share of the different source tokens that the text has; 0 without source tokens."""
    src = F.array_distinct(source)
    return F.when(F.size(src) > 0, F.size(F.array_intersect(src, text)) / F.size(src)).otherwise(0.0)


def normalize_query(c: Column) -> Column:
    """Lower case, white space folded; null when blank."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(""))


def normalize_url(c: Column, style: str = "stability") -> Column:
    """`stability`: scheme and host in lower case, no fragment, no trailing slashes of the path, an empty path as "/" (so
    null and empty give "/"), also of text that is no URL.
    `canonical`: http(s) only (else null), user info dropped too, an empty path as "/", slashes kept."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    u = F.trim(F.coalesce(c, F.lit("")))
    scheme, host, path, query = (F.regexp_extract(u, pattern, k) for k in (1, 2, 3, 4))
    if style == "canonical":
        host = F.regexp_replace(host, "^.*@", "")
        return F.when(F.lower(scheme).isin("http", "https") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path), query))
    bare = lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), bare(path), query)
    other = F.concat(bare(F.regexp_extract(u, r"(?s)^([^?#]*)", 1)), F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1))
    return F.when(u.rlike(pattern), whole).otherwise(other)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_category(host: Column) -> Column:
    """The first rule whose part the host contains; other_web, or unknown without a host."""
    out = F.lit("other_web")
    for name, parts in reversed(URL_RULES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | host.contains(p)
        out = F.when(hit, name).otherwise(out)
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown").otherwise(out)


def is_generic(query: Column) -> Column:
    low, out = F.lower(query), F.lit(False)
    for p in GENERIC_PHRASES:
        out = out | low.contains(p)
    return out


def certainty_proxy(reasoning: Column, candidate: str = r"(?i)Candidate\s+[ABC]") -> Column:
    """struct(strong, hedged, named, has_strong, has_hedge, score): score = strong - hedged / 2, plus 1/2 when one candidate at most is named."""
    strong, hedged = (F.regexp_count(reasoning, F.lit(rf"(?i)\b(?:{p})\b")) for p in (STRONG, HEDGED))
    named = F.size(F.array_distinct(F.regexp_extract_all(reasoning, F.lit(candidate), 0)))
    return F.struct(strong.alias("strong"), hedged.alias("hedged"), named.alias("named"), (strong > 0).alias("has_strong"), (hedged > 0).alias("has_hedge"), (strong - 0.5 * hedged + F.when(named <= 1, 0.5).otherwise(0.0)).alias("score"))


def text_metrics(c: Column) -> Column:
    """struct(bytes, chars, words, paragraphs, headings, bullets, urls)."""
    t = F.coalesce(c, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    lines = lambda p: F.size(F.filter(F.split(t, r"\r\n|[\n\r\x0B\f\u2028\u2029\u0085]"), lambda x: x.rlike(p))).cast("long")
    return F.struct(
        F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"), count(WORD).alias("words"),
        F.size(F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")).cast("long").alias("paragraphs"),
        lines(r"^\s{0,3}#{1,6}\s").alias("headings"), lines(r"^\s*(?:[-*+]|\d+[.)])\s+").alias("bullets"), count(r"https?://\S+").alias("urls"))


def requested_word_range(c: Column) -> Column:
    """struct(min_words, max_words) of a request such as "1,800 - 2,200-word"; null parts without one."""
    pattern = r"(?i)([0-9][0-9,]*)\s*[\u2013\u2014-]\s*([0-9][0-9,]*)\s*[- ]?word"
    number = lambda k: F.nullif(F.replace(F.regexp_extract(c, pattern, k), F.lit(","), F.lit("")), F.lit("")).cast("long")
    return F.struct(number(1).alias("min_words"), number(2).alias("max_words"))


def within_range(n: Column, bounds: Column) -> Column:
    return n.between(bounds["min_words"], bounds["max_words"])


def sample_summary(samples: DataFrame) -> DataFrame:
    """samples(text, bounds, digest): least, greatest and mean number of words, how many lie within their bounds, and whether
    each has a SHA-256 digest."""
    words = text_metrics(F.col("text"))["words"]
    return samples.withColumn("_w", words).agg(
        F.count("*").alias("samples"), F.min("_w").alias("minimum"), F.max("_w").alias("maximum"), F.round(F.avg("_w"), 1).alias("mean"),
        F.count_if(within_range(F.col("_w"), F.col("bounds"))).alias("within"), F.every(F.coalesce(F.length("digest") == 64, F.lit(False))).alias("all_hashed"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json_hash(c: Column) -> Column:
    """SHA-256 of JSON text with the keys of every object in order and no space between; null for what is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(c)), 256)


def hash64(c: Column, seed: int = 0) -> Column:
    """First 8 bytes of SHA-256 as an unsigned integer, exclusive-or seed."""
    low = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(seed).cast("long"))
    return F.conv(F.hex(low), 16, 10).cast("decimal(20,0)")


def pool_label(score: Column, least: float = 0.2) -> Column:
    return F.when(score >= least, "hard_negative").otherwise("nearest_fallback")


def truncate_text(c: Column, cap: int, mode: str = "prefix") -> Column:
    """At most cap characters: a prefix, or for `head_tail` the first 75 % and the last 25 % of cap with a 9-character mark between."""
    if mode == "prefix":
        return F.substring(c, 1, cap)
    head = int(cap * 0.75)
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("\n\n[...]\n\n"), F.right(c, F.lit(cap - head))))


def capped(stage: Column, text: Column, budget: int | None = None) -> Column:
    """A stage's text under its own cap, or under one equal budget."""
    if budget is not None:
        return truncate_text(text, budget)
    out = text
    for s, cap in CAPS.items():
        out = F.when(stage == s, truncate_text(text, cap)).otherwise(out)
    return out
