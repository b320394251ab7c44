"""Stage texts, prompts, masking and leakage."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagesignal.functions.scalars import capped, tokens
from stagesignal.sources.io import settle

OK = ("success", "ok")


def _search_lines(view: str) -> Column:
    """A search trace as lines: queries, and up to three "title: snippet" lines per successful query (below a line of their
    own where the queries are left out)."""
    def part(q: Column) -> Column:
        head = F.concat(F.lit("Query ["), F.coalesce(q["topic_id"], F.lit("")), F.lit("]: "), F.coalesce(q["query"], F.lit("")))
        lines = F.transform(F.slice(F.coalesce(q["sources"], F.array()), 1, 3), lambda s: F.concat(F.lit("  • "), F.coalesce(s["title"], F.lit("")), F.lit(": "), F.substring(F.coalesce(s["snippet"], F.lit("")), 1, 200)))
        above = F.concat(F.lit("Retrieved sources ["), F.coalesce(q["topic_id"], F.lit("")), F.lit("]:"))
        return {"full": F.concat(F.array(head), lines), "queries": F.array(head), "snippets": F.concat(F.array(above), lines)}[view]

    good = F.filter("search_trace", lambda q: q["status"].isin(*OK))
    return F.concat_ws("\n", F.flatten(F.transform(good, part)))


def _stacked(artifacts: DataFrame, texts: dict[str, Column]) -> DataFrame:
    pair = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), t.alias("text")) for s, t in texts.items()]))
    return artifacts.select("run_id", pair.alias("p")).select("run_id", "p.*").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def findings_text(compressed: str | Column = "compressed_research", name: str = "topic_text") -> Column:
    """Compressed research as "## topic" blocks, named by name or else by topic_id; a missing text counts as empty."""
    text = lambda c: F.coalesce(F.nullif(c[name], F.lit("")), c["topic_id"], F.lit(""))
    return F.concat_ws("\n\n", F.transform(compressed, lambda c: F.concat(F.lit("## "), text(c), F.lit("\n"), F.coalesce(c["compressed_research"], F.lit("")))))


def findings_of_artifacts(artifacts: DataFrame) -> DataFrame:
    """run_id and its findings for rewriting, each block and the whole trimmed; a run without any is an error."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    name = lambda c: F.coalesce(F.nullif(c["topic_text"], F.lit("")), c["topic_id"], F.lit(""))
    blocks = F.transform(F.coalesce("compressed_research", F.array()), lambda c: strip(F.concat(F.lit("## "), name(c), F.lit("\n"), F.coalesce(c["compressed_research"], F.lit("")))))
    whole = strip(F.concat_ws("\n\n", blocks))
    return artifacts.select("run_id", F.when(whole == "", F.raise_error(F.concat(F.lit("no findings: "), "run_id")).cast("string")).otherwise(whole).alias("text"))


def stage_text(artifacts: DataFrame, view: str = "full", budget: int | None = None) -> DataFrame:
    """One row per run and stage with its text, under the stage's cap or one equal budget; blank texts are dropped."""
    texts = {"plan": F.col("research_brief"), "search": _search_lines(view), "compress": findings_text(name="topic_id"), "write": F.col("final_report")}
    return _stacked(artifacts, texts).withColumn("text", capped(F.col("stage"), F.col("text"), budget))


def baseline_stage_text(artifacts: DataFrame) -> DataFrame:
    """The simpler text of the baselines, joined by spaces: queries of any status, each with "title snippet" of its first
    three results where artifacts hold any (results, not sources), compressed texts or else summaries, no caps."""
    kinds = {c: {f.name for f in artifacts.schema[c].dataType.elementType.fields} for c in ("search_trace", "compressed_research")}
    text = lambda c: F.coalesce(c, F.lit(""))

    def lines(q: Column) -> Column:
        if "results" not in kinds["search_trace"]:
            return F.array(text(q["query"]))
        return F.concat(F.array(text(q["query"])), F.transform(F.slice(F.coalesce(q["results"], F.array()), 1, 3), lambda s: F.concat(text(s["title"]), F.lit(" "), text(s["snippet"]))))

    note = lambda c: text(F.coalesce(F.nullif(c["compressed_research"], F.lit("")), c["summary"])) if "summary" in kinds["compressed_research"] else text(c["compressed_research"])
    queries = F.concat_ws(" ", F.flatten(F.transform("search_trace", lines)))
    return _stacked(artifacts, {"plan": F.col("research_brief"), "search": queries, "compress": F.concat_ws(" ", F.transform("compressed_research", note)), "write": F.col("final_report")})


def estimate_prompts(decisions: DataFrame, profiles: DataFrame, fixed: int = 1200) -> DataFrame:
    """Per stage: calls and characters of prompts made of fixed parts, the text and the candidates' profiles.
    decisions(run_id, stage, text, candidate_userids), profiles(userid, chars)."""
    rows = decisions.select("run_id", "stage", F.length("text").alias("n"), F.explode("candidate_userids").alias("userid"))
    per = rows.join(profiles, "userid", "left").groupBy("run_id", "stage").agg((F.lit(fixed) + F.first("n") + F.sum(F.coalesce("chars", F.lit(0)))).alias("chars"))
    return per.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


# Fields whose values are lists, fields that one word may mask, fields that are no clauses.
SPLIT_FIELDS = ("Name", "Age", "Gender", "Occupation", "Permanent Residence", "Hometown")
SHORT_FIELDS = ("Name", "Age", "Gender", "Permanent Residence", "Hometown")
PLAIN_FIELDS = ("Name", "Age", "Gender")


def identity_phrases(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    """Per candidate set (set_id, userid) and identity leaves: its masking phrases, longest first, then by lower case.
    A phrase is a whole value, a part of it in list-like fields, a word of a name, an occupation without article or a
    clause of a narrative field; ends are trimmed of white space and .,;: and short ones are left out."""
    none = F.array().cast("array<string>")
    v = F.trim(F.regexp_replace("value", r"\s+", " "))
    variants = F.flatten(F.array(
        F.array(v), F.when(F.col("key").isin(*SPLIT_FIELDS), F.split(v, "[,;/|]")).otherwise(none), F.when(F.col("key") == "Name", F.split(v, " ")).otherwise(none),
        F.when(F.col("key") == "Occupation", F.array(F.regexp_replace(v, r"(?i)^(?:an?|the)\s+", ""))).otherwise(none),
        F.when(F.col("key").isin(*PLAIN_FIELDS), none).otherwise(F.split(v, "[.;]"))))
    rows = leaves.select("userid", "key", F.explode(variants).alias("p")).withColumn("p", F.regexp_replace("p", r"^[ \t\r\n.,;:]+|[ \t\r\n.,;:]+$", ""))
    rows = rows.where((F.length("p") >= 3) & ((F.size(F.split("p", " ")) >= 2) | F.col("key").isin(*SHORT_FIELDS)))
    per = rows.join(sets, "userid").groupBy("set_id", F.lower("p").alias("low")).agg(F.min("p").alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("p")).alias("n"), F.col("low"), F.col("p"))))
    return per.groupBy("set_id").agg(F.transform(ordered, lambda x: x["p"]).alias("phrases"))


@functools.lru_cache(maxsize=50_000)
def _pattern(phrase: str) -> re.Pattern:
    body = r"\s+".join(map(re.escape, phrase.split()))
    return re.compile(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", re.IGNORECASE)


#: Letters that the patterns take for others without regard to case.
_ALIKE = str.maketrans({"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"})


def _plain(text: str) -> str:
    """Lower case and single spaces: what a phrase matches in a text, its plain form holds in the text's plain form."""
    return " ".join(text.translate(_ALIKE).lower().split())


@functools.lru_cache(maxsize=2000)
def _finder(phrases: tuple[str, ...], token: str) -> tuple[list[str], frozenset[int], ahocorasick.Automaton | None]:
    """A set's phrases, longest first, those that a mask may complete, and an automaton of all their plain forms."""
    ordered, own = sorted(phrases, key=lambda p: (-len(p), p.lower())), _plain(token)
    found = ahocorasick.Automaton()
    for k, p in enumerate(ordered):
        if p.split():
            found.add_word(_plain(p), (*found.get(_plain(p), ()), k))
    found.make_automaton()
    near = frozenset(k for k, p in enumerate(ordered) if own and (own in _plain(p) or any(w in own for w in _plain(p).split())))
    return ordered, near, found if len(found) else None


def _masked(text: str, phrases: tuple[str, ...], token: str) -> tuple[str, int]:
    ordered, near, finder = _finder(phrases, token)
    if finder is None:
        return text, 0
    there, n = {k for _, ks in finder.iter(_plain(text)) for k in ks} | near, 0
    for k in sorted(there):
        text, found = _pattern(ordered[k]).subn(token, text)
        n += found
    return text, n


#: Texts that are Python strings at a time.
MASK_ROWS = 100


def mask_phrases(texts: DataFrame, token: str = "[MASKED]") -> DataFrame:
    """texts(.., text, phrases): text with each phrase replaced, longest first, one after the other, and masked: how many.
    An automaton of the set's phrases finds those that occur before any pattern runs; automata and patterns are made once per
    worker and kept (the latest 2,000 and 50,000). Phrases are trimmed of white space; blank ones mask nothing."""
    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("masked", T.LongType())]))
    def masked(text: pa.Array, phrases: pa.Array) -> pa.Array:
        out, counts = [], array("q")  # the masked texts in Arrow parts, so that few of a batch's texts are Python strings at a time
        for at in range(0, len(text), MASK_ROWS):
            found = [_masked(t, tuple(ps) if ps is not None else (), token) if t is not None else (None, 0) for t, ps in zip(text[at : at + MASK_ROWS].to_pylist(), phrases[at : at + MASK_ROWS].to_pylist())]
            out.append(pa.array([t for t, _ in found], pa.string()))
            counts.extend(n for _, n in found)
        return pa.StructArray.from_arrays([pa.concat_arrays(out) if out else pa.array([], pa.string()), pa.array(counts, pa.int64())], ["text", "masked"])

    rest = [c for c in texts.columns if c not in ("text", "phrases", "masked")]
    return texts.withColumn("_m", masked("text", "phrases")).select(*rest, F.col("_m.text").alias("text"), F.col("_m.masked").alias("masked"))


Tagger = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def phrase_tagger(table: dict[str, str]) -> Tagger:
    """A tagger that knows the phrases of a table (phrase -> label)."""
    patterns = [(_pattern(p), label) for p, label in table.items()]
    return lambda texts: [[(m.start(), m.end(), label) for p, label in patterns for m in p.finditer(t)] for t in texts]


def mask_entities(texts: DataFrame, tagger: Tagger, labels: Sequence[str] = ("PERSON", "ORG", "GPE", "NORP", "FAC")) -> DataFrame:
    """Replaces the spans that the caller's batch tagger finds by [LABEL]; entities counts them. Overlaps: the first, then the longest."""
    columns = [c for c in texts.columns if c != "entities"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = tagger([t if isinstance(t, str) else "" for t in batch["text"]])
            out, counts = [], []
            for t, spans in zip(batch["text"], found):
                parts, at, n = [], 0, 0
                for a, b, label in sorted((s for s in spans if s[2] in labels), key=lambda s: (s[0], -s[1])):
                    if a >= at:
                        parts += [t[at:a], f"[{label}]"]
                        at, n = b, n + 1
                out.append("".join([*parts, t[at:]]) if isinstance(t, str) else t)
                counts.append(n)
            yield batch[columns].assign(text=out, entities=counts)

    schema = T.StructType([f for f in texts.schema.fields if f.name != "entities"]).add("entities", T.LongType())
    return texts.mapInPandas(run, schema)


#: Texts of an artifact by stage: of its own, of the items of a list, and of the items of lists within those.
PLACES = {
    "plan": {"research_brief": {}},
    "search": {"search_trace": {"query": {}, "sources": {"title": {}, "snippet": {}, "query": {}}, "results": {"title": {}, "snippet": {}, "query": {}}}},
    "compress": {"compressed_research": {"compressed_research": {}, "summary": {}}},
    "write": {"final_report": {}},
}


def artifact_fields(artifacts: DataFrame) -> DataFrame:
    """run_id, stage, place, text: every text of nested artifacts that is there, with its address in the artifact, such as
    search_trace/2/sources/0/title."""
    def fields(name: str, at: Column, value: Column, kind: T.DataType, inner: dict, stage: str) -> Column | None:
        if isinstance(kind, T.ArrayType):
            def item(x: Column, i: Column) -> Column:
                parts = [fields(k, F.concat_ws("/", at, i.cast("string"), F.lit(k)), x[k], kind.elementType[k].dataType, deeper, stage) for k, deeper in inner.items() if k in kind.elementType.names]
                return F.concat(*parts)

            return F.flatten(F.transform(F.coalesce(value, F.array()), item))
        one = F.struct(F.lit(stage).alias("stage"), at.alias("place"), value.cast("string").alias("text"))
        return F.filter(F.array(one), lambda x: x["text"].isNotNull())

    every = [fields(name, F.lit(name), F.col(name), artifacts.schema[name].dataType, inner, stage) for stage, names in PLACES.items() for name, inner in names.items() if name in artifacts.columns]
    return artifacts.select("run_id", F.explode(F.concat(*every)).alias("f")).select("run_id", "f.*")


def rebuild_artifacts(artifacts: DataFrame, fields: DataFrame) -> DataFrame:
    """Artifacts with the texts of fields(run_id, place, text) at their places; what fields lacks stays as it was."""
    def put(at: Column, value: Column, kind: T.DataType, inner: dict) -> Column:
        if isinstance(kind, T.ArrayType):
            def item(x: Column, i: Column) -> Column:
                out = x
                for k, deeper in inner.items():
                    if k in kind.elementType.names:
                        out = out.withField(k, put(F.concat_ws("/", at, i.cast("string"), F.lit(k)), x[k], kind.elementType[k].dataType, deeper))
                return F.when(x.isNotNull(), out)

            return F.transform(value, item)
        return F.coalesce(F.try_element_at("_new", at), value)

    new = fields.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("_new"))
    names = {name: inner for places in PLACES.values() for name, inner in places.items() if name in artifacts.columns}
    joined = artifacts.join(new, "run_id", "left")
    return joined.withColumns({name: put(F.lit(name), F.col(name), artifacts.schema[name].dataType, inner) for name, inner in names.items()}).drop("_new")


def mask_artifacts(artifacts: DataFrame, sets: DataFrame, phrases: DataFrame, tagger: Tagger | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested artifacts with all their texts masked by the phrases of their candidate set, then by the tagger's entities,
    and the audit: per run and stage the replacements of both, the set's number of phrases and the hash of its list.

    artifacts(run_id, ..) as read, sets(run_id, set_id), phrases(set_id, phrases). Artifacts are taken apart into fields with
    their places, each field travels once, and the masked ones are put together again."""
    known = sets.join(phrases, "set_id", "left").select("run_id", F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"))
    known = known.withColumns({"n_phrases": F.size("phrases"), "phrase_hash": F.sha2(F.concat_ws("\n", "phrases"), 256)})
    masked = mask_phrases(artifact_fields(artifacts).join(known, "run_id", "left"))
    masked = settle(mask_entities(masked, tagger) if tagger else masked.withColumn("entities", F.lit(0).cast("long")))
    audit = masked.groupBy("run_id", "stage").agg(F.sum("masked").alias("masked"), F.sum("entities").alias("entities"), F.first("n_phrases").alias("n_phrases"), F.first("phrase_hash").alias("phrase_hash"))
    return rebuild_artifacts(artifacts, masked), audit


def masking_totals(audit: DataFrame) -> DataFrame:
    """Per stage over all runs: replacements, runs, the most phrases, and how many lists of phrases."""
    return audit.groupBy("stage").agg(F.sum("masked").alias("masked"), F.sum("entities").alias("entities"), F.count_distinct("run_id").alias("runs"), F.max("n_phrases").alias("most_phrases"), F.count_distinct("phrase_hash").alias("phrase_lists"))


#: Rows of one side of a leakage join that may be broadcast, and parts that the other way deals hot keys into.
MOST_SENT, SALTS = 2_000_000, 16
#: Profiles' tokens whose frequency sentence prefixes are ordered by.
FREQUENT = 500


def token_statistics(rows: DataFrame, keys: Sequence[str], toks: Column) -> DataFrame:
    """Entropy in bits, type-token ratio and number of the tokens of each key, whatever their number. A key of one row is
    counted within the row, so that a task holds the tokens of one row; keys of several rows are counted over them."""
    from pyspark.sql.window import Window

    one = lambda t: F.transform(t, lambda x: F.struct(x.alias("t"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("double").alias("logs"), F.lit(None).cast("long").alias("k")))
    told = rows.select(*keys, toks.alias("_t"), F.count("*").over(Window.partitionBy(*keys)).alias("_rows"))
    # Of a row alone: its tokens in order, where each token's run ends, and the runs' lengths. Its sums have no token.
    told = told.withColumn("_s", F.when((F.col("_rows") == 1) & (F.size("_t") > 0), F.sort_array("_t")))
    last = lambda i: (i == F.size("_s")) | ~F.get("_s", i - 1).eqNullSafe(F.get("_s", i))
    told = told.withColumn("_ends", F.filter(F.sequence(F.lit(1), F.size("_s")), last))
    told = told.withColumn("_n", F.transform("_ends", lambda e, j: e - F.coalesce(F.get("_ends", j - 1), F.lit(0))))
    alone = F.struct(F.get("_t", F.lit(-1)).alias("t"), F.size("_t").cast("long").alias("n"), F.aggregate("_n", F.lit(0.0), lambda x, n: x + n * F.log2(n)).alias("logs"), F.size("_n").cast("long").alias("k"))
    parts = F.when(F.col("_rows") > 1, one(F.col("_t"))).when(F.size("_t") > 0, F.array(alone))
    counts = told.select(*keys, F.explode(parts).alias("_p")).groupBy(*keys, F.col("_p.t").alias("_t")).agg(F.sum("_p.n").alias("_n"), F.sum("_p.logs").alias("_logs"), F.sum("_p.k").alias("_k"))
    total = F.sum("_n")
    logs, distinct = F.sum(F.coalesce("_logs", F.col("_n") * F.log2("_n"))), F.sum(F.coalesce("_k", F.lit(1)))
    return counts.groupBy(*keys).agg((F.log2(total) - logs / total).alias("entropy"), (distinct / total).alias("ttr"), total.alias("tokens"))


def _on_key(large: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """Joins on key. small is broadcast while its number of rows is bounded; beyond, a hot key of large is dealt into parts."""
    if rows <= MOST_SENT:
        return large.join(F.broadcast(small), key)
    part = F.pmod(F.xxhash64(*[c for c in large.columns if c != key]), F.lit(SALTS)).cast("int")
    return large.withColumn("_salt", part).join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def gram_hashes(hashes: Column, n: int) -> Column:
    """struct(pos, h, k) of each n tokens in a row, from the tokens' hashes: two hashes, 96 bits in all. hashes should be a
    column, not a computation: each gram reads it."""
    def gram(i: Column) -> Column:
        own = [F.element_at(hashes, i + j) for j in range(n)]
        return F.struct(i.alias("pos"), F.xxhash64(*own).alias("h"), F.hash(*own).alias("k"))

    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), gram)).otherwise(F.array())


def leakage_spans(texts: DataFrame, profiles: DataFrame, n: int = 5) -> DataFrame:
    """Runs of n or more tokens that a text shares with a profile: per pair the spans (gaps and islands) with their tokens.
    texts(text_id, text), profiles(profile_id, text). Grams meet by their hashes alone; those of profiles are made distinct."""
    from pyspark.sql.window import Window

    a, b = (df.withColumn("_hashes", F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))) for df in (texts, profiles))
    grams = b.select("profile_id", F.explode(gram_hashes(F.col("_hashes"), n)).alias("g")).select("profile_id", "g.h", "g.k").distinct()
    places = a.select("text_id", F.explode(gram_hashes(F.col("_hashes"), n)).alias("g")).select("text_id", "g.pos", "g.h", F.col("g.k").alias("own"))
    hits = _on_key(places, grams, "h", grams.count()).where("own = k").select("text_id", "profile_id", "pos")
    w = Window.partitionBy("text_id", "profile_id").orderBy("pos")
    island = F.col("pos") - F.row_number().over(w)
    return hits.withColumn("island", island).groupBy("text_id", "profile_id", "island").agg(F.min("pos").alias("start"), (F.count("*") + n - 1).alias("tokens")).drop("island")


def leakage_sentences(texts: DataFrame, profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """Sentence pairs with token Jaccard of at least `least`. Prefix filter: in any one order of all tokens two such sets share
    one of their first |set| - ceil(least * |set|) + 1, so only those are joined; the overlap is then checked exactly. Tokens
    are ordered by hash, of the profiles' tokens the FREQUENT most frequent last, in three tiers; a hash that two tokens have
    only adds candidates. While the profiles' side is bounded, it is broadcast and texts are read once and never travel."""
    def sentences(df: DataFrame, key: str) -> DataFrame:
        s = df.select(key, F.posexplode(F.split("text", r"[.!?\n]+")).alias(f"{key}_s", "sentence"))
        return s.select(key, f"{key}_s", F.array_distinct(tokens(F.col("sentence"))).alias("toks"))

    a, b = sentences(texts, "text_id"), sentences(profiles, "profile_id")
    counts = b.select(F.explode("toks").alias("t")).groupBy("t").count()
    often = [r["t"] for r in counts.orderBy(F.desc("count"), "t").limit(FREQUENT).collect()]
    tiers = [often[: FREQUENT // 100], often[: FREQUENT // 10], often]

    def place(t: Column) -> Column:
        tier = F.lit(0)
        for k, listed in enumerate(reversed(tiers), 1):
            tier = F.when(t.isin(listed or [""]), k).otherwise(tier)
        return F.shiftleft(tier.cast("long"), 60) + F.shiftrightunsigned(F.xxhash64(t), 4)

    def prefixes(df: DataFrame) -> DataFrame:
        keep = F.size("toks") - F.ceil(least * F.size("toks")).cast("int") + 1
        return df.select("*", F.array_distinct(F.slice(F.sort_array(F.transform("toks", place)), 1, keep)).alias("first"))

    ka, kb = ["text_id", "text_id_s"], ["profile_id", "profile_id_s"]
    b = b.withColumnsRenamed({"toks": "other"})
    right = prefixes(b.withColumn("toks", F.col("other"))).drop("toks").withColumnRenamed("first", "others")
    met = right.select(*kb, F.size("other").alias("m"), F.explode("others").alias("t"))
    rows = met.count()
    n = F.size("toks")
    if rows <= MOST_SENT:
        near = prefixes(a).select("*", F.explode("first").alias("t")).join(F.broadcast(met), "t").where((F.col("m") >= least * n) & (n >= least * F.col("m")))
        full = near.join(F.broadcast(right), kb).where(F.get(F.array_intersect("first", "others"), F.lit(0)) == F.col("t"))  # each pair once
    else:
        left = prefixes(a).select(*ka, n.alias("n"), F.explode("first").alias("t"))
        pairs = _on_key(left, met, "t", rows).where((F.col("m") >= least * F.col("n")) & (F.col("n") >= least * F.col("m"))).select(*ka, *kb).distinct()
        full = pairs.join(a, ka).join(b, kb)
    shared = F.size(F.array_intersect("toks", "other"))
    score = shared / (F.size("toks") + F.size("other") - shared)
    return full.withColumn("jaccard", F.round(score, 6)).where(score >= least).select(*ka, *kb, "jaccard")


def embed_profile(query: Column, profile: Column) -> Column:
    """The run prompt: the query, with the profile block unless it holds one already."""
    return F.when(query.contains("=== Profile ==="), query).otherwise(F.concat(query, F.lit("\n\n=== Profile ===\n"), profile))


def strip_profile(prompt: Column) -> Column:
    return F.regexp_replace(prompt, r"(?s)\n\n=== Profile ===\n.*$", "")


