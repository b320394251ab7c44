"""From event logs to artifacts: topics, tool calls, ledgers, sources, caps, and the checks on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagesignal.functions.scalars import normalize_query, normalize_url
from stagesignal.sources.io import settle

UNMAPPED = "topic_unmapped"
#: Arrivals of a block.
BLOCK = 4096


def assign_topics(events: DataFrame) -> DataFrame:
    """events(report_run, ord, id, parent_ids, topic_text): each run's different topic texts are numbered as first seen;
    an event without a text takes the topic of its nearest known parent (the last of parent_ids), else topic_unmapped."""
    told, mute = events.where("topic_text is not null"), events.where("topic_text is null")
    texts = told.groupBy("report_run", "topic_text").agg(F.min("ord").alias("first"))
    number = F.row_number().over(Window.partitionBy("report_run").orderBy("first"))
    texts = texts.select("report_run", "topic_text", F.format_string("topic_%03d", number).alias("topic_id"))
    known = told.select("report_run", "ord", "id", "topic_text").join(texts, ["report_run", "topic_text"]).select("report_run", "ord", "id", "topic_id")
    lent = known.select("report_run", F.col("id").alias("parent"), F.col("topic_id").alias("lent"))
    asked = mute.select("report_run", "ord", "id", F.posexplode_outer("parent_ids").alias("pos", "parent"))
    near = asked.join(lent, ["report_run", "parent"], "left").groupBy("report_run", "ord", "id").agg(F.max_by("lent", F.when(F.col("lent").isNotNull(), F.col("pos"))).alias("lent"))
    return known.unionByName(near.select("report_run", "ord", "id", F.coalesce("lent", F.lit(UNMAPPED)).alias("topic_id")))


#: What a tool call's output holds, where it is JSON.
OUTPUT = "queries array<struct<query: string, attempted: boolean, status: string, failure_code: string, sources: array<struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>>>>"


def claims(uses: DataFrame, log: DataFrame) -> DataFrame:
    """uses(report_run, query, at, pos) with taken: the number (from 1) of the log record of its run and query that each
    use takes, or null. In the order of time a use takes the first record that was there and that no one took before.

    Were every use served, the i-th would take the i-th record; one that finds none lets all later ones slip back. So the
    number of records taken up to a use is i + min(0, least of R - j), where R are the records there at the j-th use: two
    running sums and a running minimum, no loop. log(report_run, query, at)."""
    keys = ["report_run", "query"]
    both = uses.select(*keys, "at", "pos", F.lit(1).alias("use")).unionByName(log.select(*keys, "at", F.lit(-1).alias("pos"), F.lit(0).alias("use")))
    upto = Window.partitionBy(*keys).orderBy("at", "use", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumns({"i": F.sum("use").over(upto), "there": F.sum(1 - F.col("use")).over(upto)}).where("use = 1")
    order = Window.partitionBy(*keys).orderBy("i")
    counted = counted.withColumn("short", F.least(F.lit(0), F.min(F.col("there") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    served = F.col("short") == F.coalesce(F.lag("short").over(order), F.lit(0))
    return counted.select(*keys, "at", "pos", F.when(served, F.col("i") + F.col("short")).alias("taken"))


def pair_tool_calls(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row per query of each started search call: query_id, query, attempted, status, failure_code, sources.

    events(report_run, ord, event, call_id, topic_id, queries, output): a tool_start opens its queries, numbered within
    run and topic by start; tool_end and tool_error of the call (the latest start before them) settle them, the last one
    counts. An end claims for each query the first unclaimed record of the same text that the search log has by then; if
    it gets none at all, it reads the records from its output, by position. A query without a record is
    trace_missing_query_result (of an output that is no JSON, without a log, unstructured_search_output), one
    whose call failed tool_execution_error, one whose call never ended trace_incomplete_tool_call.
    log(report_run, ord, query_sequence, query, attempted, status, failure_code, sources): ord is when a record is there."""
    calls = events.where(F.col("event").isin("tool_start", "tool_end", "tool_error")).withColumn("call_id", F.coalesce("call_id", F.lit("")))
    opens = F.sum((F.col("event") == "tool_start").cast("int")).over(Window.partitionBy("report_run", "call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    calls = calls.withColumn("call", opens).where("call > 0")
    keys = ["report_run", "call_id", "call"]
    opened = calls.where("event = 'tool_start'").select(*keys, F.col("ord").alias("start"), F.coalesce("topic_id", F.lit(UNMAPPED)).alias("topic_id"), F.posexplode("queries").alias("pos", "query"))
    number = F.row_number().over(Window.partitionBy("report_run", "topic_id").orderBy("start", "call_id", "pos"))
    opened = opened.withColumn("query_id", F.format_string("%s_query_%03d", "topic_id", number)).withColumn("query", F.coalesce("query", F.lit("None")))
    settled = calls.where("event <> 'tool_start'").select(*keys, F.col("ord").alias("at"), (F.col("event") == "tool_end").alias("ended"), "output")
    tried = opened.join(settled, keys, "left")
    record = F.from_json("output", OUTPUT)["queries"]
    if log is None:
        tried = tried.withColumn("own", F.lit(None).cast("struct<query: string, attempted: boolean, status: string, failure_code: string, sources: array<struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>>>"))
    else:
        place = F.row_number().over(Window.partitionBy("report_run", "query").orderBy("query_sequence"))
        records = log.select("report_run", "query", place.alias("taken"), F.struct("query", "attempted", "status", "failure_code", "sources").alias("own"))
        mine = claims(tried.where("ended"), log.withColumn("at", F.col("ord"))).where("taken is not null").join(records, ["report_run", "query", "taken"])
        tried = tried.join(mine.drop("taken"), ["report_run", "query", "at", "pos"], "left")
    settlement = Window.partitionBy(*keys, "at")
    none = F.count("own").over(settlement) == 0
    parsed = F.size(F.coalesce(record, F.array())) > 0
    got = F.when(F.col("ended"), F.when(none & parsed, F.try_element_at(record, F.col("pos") + 1)).otherwise(F.col("own")))
    plain = F.lit(log is None) & none & F.get_json_object("output", "$").isNull()
    last = F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.desc("at")))
    rows = tried.withColumns({"r": got, "plain": plain, "last": last}).where("last = 1")
    there = F.col("r").isNotNull()
    code = F.when(F.col("at").isNull(), "trace_incomplete_tool_call").when(~F.col("ended"), "tool_execution_error").when(there, F.col("r.failure_code")).when(F.col("plain"), "unstructured_search_output").otherwise("trace_missing_query_result")
    text = F.coalesce("r.query", "query")
    source = lambda x: F.struct(F.coalesce(x["query"], text).alias("query"), *[F.coalesce(x[c], F.lit("")).alias(c) for c in ("title", "link", "domain")], x["rank"].alias("rank"), F.coalesce(x["snippet"], F.lit("")).alias("snippet"))
    return rows.select("report_run", "call_id", "query_id", "topic_id", text.alias("query"), F.when(there, F.coalesce("r.attempted", F.lit(False))).otherwise(F.lit(True)).alias("attempted"),
                       F.when(there & (F.col("r.status") == "ok"), "ok").otherwise("failure").alias("status"), code.alias("failure_code"), F.coalesce(F.transform("r.sources", source), F.array()).alias("sources"))


def token_ledger(events: DataFrame) -> DataFrame:
    """Tokens per run, each model call counted once: by its first event that has any usage; events without a call's id do
    not count. events(report_run, ord, event, call_id, input_tokens, output_tokens, prompt_tokens, completion_tokens): the
    last two are other names of the first two, taken where those are null or 0."""
    used = events.where("event = 'model_end' and coalesce(call_id, '') <> '' and coalesce(input_tokens, output_tokens, prompt_tokens, completion_tokens) is not null")
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b), F.lit(0))
    first = used.groupBy("report_run", "call_id").agg(F.min_by(F.struct(either("input_tokens", "prompt_tokens").alias("i"), either("output_tokens", "completion_tokens").alias("o")), "ord").alias("u"))
    totals = first.groupBy("report_run").agg(F.sum("u.i").alias("input_tokens"), F.sum("u.o").alias("output_tokens"), F.count("*").alias("token_usage_events"))
    return totals.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def capture_latest(events: DataFrame) -> DataFrame:
    """Per run and slot the text that counts, trimmed: the last non-blank brief; per topic the last compressed text that is no
    error report; and of the reports that are no error reports the last of the final node, or where it gave none the first.
    events(report_run, ord, slot, text, is_final): slots are brief, compressed and a topic, report."""
    raw = F.coalesce("text", F.lit(""))
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    begins = lambda c: F.greatest(*[c.startswith(p) for p in ERROR_REPORTS])
    good = (text != "") & F.when(F.col("slot") == "brief", True).when(F.col("slot") == "report", ~begins(text)).otherwise(~begins(raw))
    early = (F.col("slot") == "report") & ~F.coalesce("is_final", F.lit(False))
    order = F.struct((~early).alias("final"), F.when(early, -F.col("ord")).otherwise(F.col("ord")).alias("o"))
    return events.where(good).groupBy("report_run", "slot").agg(F.max_by(text, order).alias("text"))


def _sources() -> Column:
    return F.flatten(F.transform(_listed("search_trace"), lambda q: F.coalesce(q["sources"], F.array())))


TERMINAL = ("ok", "success", "failure", "failed")
# The version of the artifact format, its service tiers, and how reports of a failed run begin.
SCHEMA_VERSION = "dra_trace_v2"
SERVICE_TIERS = ("flex", "default")
ERROR_REPORTS = ("Error generating final report:", "Error synthesizing research report:")
COUNTERS = ("input_tokens", "output_tokens", "total_tokens", "token_usage_events", "queries_requested", "queries_attempted", "queries_successful", "queries_failed", "queries_rejected", "sources_selected", "unique_sources")
COUNTED = COUNTERS[4:]


def _ok(q: Column) -> Column:
    return F.coalesce(q["status"].isin("ok", "success"), F.lit(False))


def _attempted(q: Column) -> Column:
    return F.coalesce(q["attempted"], F.lit(False))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array())


def _found() -> dict[str, Column]:
    """The counters that an artifact's trace gives."""
    n = lambda keep: F.size(F.filter(_listed("search_trace"), keep)).cast("long")
    links = F.filter(F.transform(_sources(), lambda s: s["link"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return {"queries_requested": F.size(_listed("search_trace")).cast("long"), "queries_attempted": n(_attempted), "queries_successful": n(_ok), "queries_failed": n(lambda q: _attempted(q) & ~_ok(q)),
            "queries_rejected": n(lambda q: ~_attempted(q)), "sources_selected": F.size(_sources()).cast("long"), "unique_sources": F.size(F.array_distinct(links)).cast("long")}


def _topics() -> Column:
    return F.transform(_listed("research_topics"), lambda t: t["topic_id"])


def _sourced() -> Column:
    """Topics with a successful query that has a source."""
    good = F.filter(_listed("search_trace"), lambda q: _ok(q) & (F.size(F.coalesce(q["sources"], F.array())) > 0))
    return F.array_distinct(F.transform(good, lambda q: q["topic_id"]))


def _reported() -> Column:
    return ~_blank(F.col("final_report")) & ~F.greatest(*[F.col("final_report").startswith(p) for p in ERROR_REPORTS])


def trace_ledger(artifacts: DataFrame, log: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Counters of an artifact's trace, its model usage, whether its parts are complete, and whether the search log agrees.

    usage(run_id, input_tokens, output_tokens, token_usage_events) and log(run_id and the counters of COUNTED but for
    rejected ones) have a row per run; without a log its counts are taken to agree. Nothing else leaves the row."""
    topics, compressed = _topics(), F.transform(_listed("compressed_research"), lambda c: c["topic_id"])
    terminal = (F.size(_listed("search_trace")) > 0) & F.forall(_listed("search_trace"), lambda q: F.coalesce(q["status"].isin(*TERMINAL), F.lit(False)))
    flags = {"has_brief": ~_blank(F.col("research_brief")), "has_topics": F.size(topics) > 0,
             "has_query_and_source": terminal & (F.size(topics) > 0) & (F.size(F.array_except(topics, _sourced())) == 0),
             "has_compressed_per_topic": (F.size(topics) > 0) & (F.array_sort(F.array_distinct(topics)) == F.array_sort(F.array_distinct(compressed))),
             "has_report": F.coalesce(_reported(), F.lit(False))}
    out = artifacts.select("run_id", *[c.alias(n) for n, c in _found().items()], *[c.alias(n) for n, c in flags.items()])
    out = out.withColumn("complete", F.least(*map(F.col, flags)))
    if usage is not None:
        names = ("input_tokens", "output_tokens", "token_usage_events")
        out = out.join(usage.select("run_id", *names), "run_id", "left").na.fill(0, list(names)).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    same = lambda names: F.coalesce(F.least(*[F.col(c) == F.col("_" + c) for c in names]), F.lit(False))
    queries, sources = COUNTED[:4], COUNTED[5:]
    if log is None:
        return out.withColumns({"query_ledger_consistent": F.lit(True), "source_ledger_consistent": F.lit(True)})
    joined = out.join(log.select("run_id", *[F.col(c).alias("_" + c) for c in (*queries, *sources)]), "run_id", "left")
    return joined.withColumns({"query_ledger_consistent": same(queries), "source_ledger_consistent": same(sources)}).drop(*["_" + c for c in (*queries, *sources)])


def _numbered(items: Column, wrong, text: str) -> Column:
    """"place: text" for each item (from 0) that is wrong."""
    marked = F.transform(items, lambda x, i: F.when(F.coalesce(wrong(x, i), F.lit(True)), F.concat(i.cast("string"), F.lit(f": {text}"))))
    return F.array_compact(marked)


def _messages(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail or cannot be told."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def validate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Arrays of schema, completeness and ledger errors per artifact and two flags, by higher-order functions only. A value
    of the wrong type is read as null, which counts as missing. An artifact that lacks a part, or whose configuration is
    wrong, is not looked into any further."""
    config = lambda c: F.col(f"execution_config.{c}")
    parts = _messages({
        "schema_version: unsupported": F.col("schema_version") == SCHEMA_VERSION, "run_id: missing": ~_blank(F.col("run_id")),
        **{f"{c}: missing": F.col(c).isNotNull() for c in ("research_brief", "research_topics", "search_trace", "compressed_research", "final_report", "execution_config", "token_ledger")},
        "generation_seed: missing": config("generation_seed").isNotNull(), "models: missing": config("models").isNotNull(), "timeout_sec: not positive": config("timeout_sec") > 0,
        "service_tier: unknown": config("service_tier").isin(*SERVICE_TIERS), **{f"{c}: no SHA-256": config(c).rlike("^[0-9a-f]{64}$") for c in ("manifest_sha256", "prompt_sha256")}})
    topics, trace, compressed = _listed("research_topics"), _listed("search_trace"), _listed("compressed_research")
    ids = F.transform(trace, lambda q: q["query_id"])
    wanted = F.transform(topics, lambda t, i: F.concat(F.lit("topic_"), F.lpad((i + 1).cast("string"), 3, "0")))
    source_ok = lambda s: (s["rank"] >= 1) & s["query"].isNotNull() & s["title"].isNotNull() & s["link"].isNotNull() & s["domain"].isNotNull() & s["snippet"].isNotNull()
    inner = F.concat(
        F.when(F.size(topics) == 0, F.array().cast("array<string>")).when(_topics() == wanted, F.array().cast("array<string>")).otherwise(F.array(F.lit("topics: not in order"))),
        _numbered(topics, lambda t, i: _blank(t["topic_text"]), "topic without text"),
        _numbered(trace, lambda q, i: F.array_position(ids, q["query_id"]) != i + 1, "query id missing or repeated"),
        _numbered(trace, lambda q, i: ~F.array_contains(F.concat(_topics(), F.array(F.lit(UNMAPPED))), q["topic_id"]), "unknown topic"),
        _numbered(trace, lambda q, i: F.coalesce(q["query"], F.lit("")) == "", "query without text"),
        _numbered(trace, lambda q, i: q["attempted"].isNull(), "attempted: missing"),
        _numbered(trace, lambda q, i: ~q["status"].isin(*TERMINAL), "status not terminal"),
        _numbered(trace, lambda q, i: q["sources"].isNull(), "sources: missing"),
        _numbered(trace, lambda q, i: F.exists(F.coalesce(q["sources"], F.array()), lambda s: ~F.coalesce(source_ok(s), F.lit(False))), "source incomplete"),
        _numbered(compressed, lambda c, i: F.coalesce(c["compressed_research"], F.lit("")) == "", "compressed text empty"))
    known = F.array_sort(F.array_distinct(F.filter(_topics(), lambda t: t.isNotNull())))
    bare = F.array_except(known, _sourced())
    complete = F.concat(
        _numbered(trace, lambda q, i: F.coalesce(q["topic_id"], F.lit("")) == UNMAPPED, "query of no topic"),
        _messages({"research_brief: empty": F.col("research_brief") != "", "research_topics: empty": F.size(topics) > 0, "search_trace: empty": F.size(trace) > 0}),
        F.when(F.size(bare) > 0, F.array(F.concat(F.lit("no successful source: "), F.concat_ws(", ", bare)))).otherwise(F.array().cast("array<string>")),
        _messages({"compressed_research: not one to one": F.array_sort(F.transform(compressed, lambda c: c["topic_id"])) == F.array_sort(_topics()), "final_report: empty or failed": _reported()}))
    stated = {c: F.col(f"token_ledger.{c}") for c in COUNTERS}
    odd = _messages({f"{c}: missing or negative": stated[c] >= 0 for c in COUNTERS})
    differ = F.array_compact(F.array(*[F.when(stated[c] != n, F.concat(F.lit(f"{c}: "), stated[c].cast("string"), F.lit(" stated, "), n.cast("string"), F.lit(" found"))) for c, n in _found().items()]))
    sums = F.concat(differ, _messages({
        "total_tokens: not the sum": stated["total_tokens"] == stated["input_tokens"] + stated["output_tokens"], "token_usage_events: none": stated["token_usage_events"] > 0,
        "query ledger: differs from the log": F.col("token_ledger.query_ledger_consistent"), "source ledger: differs from the log": F.col("token_ledger.source_ledger_consistent")}))
    ledger = F.when(F.size(odd) > 0, odd).otherwise(sums)
    rows = artifacts.withColumn("_parts", parts)
    fine, nothing = F.size("_parts") == 0, F.array().cast("array<string>")
    out = rows.select("run_id", F.when(fine, inner).otherwise(F.col("_parts")).alias("schema_errors"), F.when(fine, complete).otherwise(nothing).alias("completeness_errors"), F.when(fine, ledger).otherwise(nothing).alias("ledger_errors"))
    sizes = [F.size(c) == 0 for c in ("schema_errors", "completeness_errors", "ledger_errors")]
    return out.withColumn("schema_valid", sizes[0]).withColumn("success_criteria_met", sizes[0] & sizes[1] & sizes[2])


def _valid_results(responses: DataFrame, per_query: int) -> DataFrame:
    """The first per_query results of each query that have a canonical link, with their place in the list."""
    names = {f.name for f in responses.schema["organic"].dataType.elementType.fields}
    text = lambda c: F.trim(F.coalesce(F.col(f"o.{c}"), F.lit(""))) if c in names else F.lit("")
    rank = F.when(F.col("o.position") >= 1, F.col("o.position").cast("int")).otherwise(F.col("pos") + 1) if "position" in names else F.col("pos") + 1
    rows = responses.select("report_run", "query_sequence", F.col("query") if "query" in responses.columns else F.lit(None).cast("string").alias("query"), F.posexplode(F.slice("organic", 1, per_query)).alias("pos", "o"))
    rows = rows.withColumn("link", normalize_url(F.col("o.link"), "canonical")).where("link is not null")
    return rows.select("report_run", "query_sequence", "pos", "query", text("title").alias("title"), "link", F.regexp_extract("link", "^[^:]+://([^/?#]*)", 1).alias("domain"), rank.alias("rank"), text("snippet").alias("snippet"))


def select_sources(responses: DataFrame, per_query: int = 3, per_run: int = 15) -> DataFrame:
    """responses(report_run, query_sequence, query, organic: title, link, position, snippet): the first per_query results of
    each query that are new to the run, in canonical form with title, domain, rank and snippet, per_run at most. A run's
    rows meet in one window; nothing crosses runs."""
    order = ["query_sequence", "pos"]
    first = _valid_results(responses, per_query).withColumn("k", F.row_number().over(Window.partitionBy("report_run", "link").orderBy(*order))).where("k = 1").drop("k")
    return first.withColumn("source", F.row_number().over(Window.partitionBy("report_run").orderBy(*order))).where(F.col("source") <= per_run)


def query_outcomes(responses: DataFrame, selected: DataFrame, per_query: int = 3) -> DataFrame:
    """Per query: selected sources and the failure code, if it has none: empty_organic (no list or an empty one),
    malformed_organic (none of its first per_query results has a usable link), no_new_sources."""
    n = selected.groupBy("report_run", "query_sequence").agg(F.count("*").alias("sources"))
    joined = responses.join(n, ["report_run", "query_sequence"], "left").na.fill(0, ["sources"])
    usable = F.exists(F.slice("organic", 1, per_query), lambda o: normalize_url(o["link"], "canonical").isNotNull())
    code = F.when(F.coalesce(F.size("organic"), F.lit(0)) <= 0, "empty_organic").when(~F.coalesce(usable, F.lit(False)), "malformed_organic").when(F.col("sources") == 0, "no_new_sources")
    return joined.select("report_run", "query_sequence", "sources", code.alias("failure_code"))


def _cut_off(calls: DataFrame, overall: int) -> tuple | None:
    """The call (order, n) at which the sum of n in order of arrival reaches overall, with what it may still have; None if it
    never does. Sums of blocks of blocks, then of blocks, then of one block's calls: each look is at a bounded number of rows."""
    left, rows = overall, calls.withColumns({"block": F.floor(F.col("order.ord") / BLOCK), "far": F.floor(F.col("order.ord") / BLOCK / BLOCK)})
    for level in ("far", "block"):
        for r in rows.groupBy(level).agg(F.sum("n").alias("m")).orderBy(level).toLocalIterator():  # a row per 16 million arrivals, then 4096 at most
            if r["m"] >= left:
                rows = rows.where(F.col(level) == r[level])
                break
            left -= r["m"]
        else:
            return None
    for r in rows.select("order", "n").orderBy("order").toLocalIterator():
        if r["n"] >= left:
            return r["order"], left
        left -= r["n"]
    return None


def admit_queries(requests: DataFrame, per_call: int = 5, per_run: int = 7, overall: int = 2400) -> DataFrame:
    """requests(ord, report_run, call_id, query): attempted or the cap that rejects it.

    Calls are served in the order of their first valid query (then by id). Each asks for its first per_call valid queries, as far as its
    run has room; what it asks for is granted until all runs together have had `overall`. Only granted queries use up a
    run's room: beyond that point the room of each run stays what it was, and what a call asks for is refused by the
    global cap, the rest by that of the report. Queries with one arrival number keep the order of the table.

    Of a call only the first few are put in order, and of a run the first calls, which are all that can use its room."""
    rows = settle(requests.withColumns({"_row": F.monotonically_increasing_id(), "_valid": normalize_query(F.col("query")).isNotNull()}))
    own = ["report_run", "call_id"]
    place = F.row_number().over(Window.partitionBy(*own).orderBy("ord", "_row"))
    few = rows.where("_valid").withColumn("k", place).where(F.col("k") <= per_call).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("ord", "_row"))).alias("few"))
    few = settle(few.withColumn("order", F.struct(F.col("few")[0]["ord"].alias("ord"), F.col("call_id").alias("call_id"), F.col("report_run").alias("report_run"))))
    turn = Window.partitionBy("report_run").orderBy("order")
    early = few.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= per_run)
    upto = F.sum(F.size("few")).over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.least(upto, F.lit(per_run)) - F.least(upto - F.size("few"), F.lit(per_run))
    early = settle(early.select(*own, "order", n.alias("n")))
    cut = _cut_off(early, overall)
    order = F.lit(None) if cut is None else F.struct(*[F.lit(cut[0][c]).alias(c) for c in ("ord", "call_id", "report_run")])
    before, at = (F.lit(True), F.lit(False)) if cut is None else (F.col("order") < order, F.col("order") == order)
    granted = F.when(before, F.col("n")).when(at, F.lit(0 if cut is None else cut[1])).otherwise(0)
    early = early.withColumn("granted", granted)
    room = early.groupBy("report_run").agg((per_run - F.sum("granted")).alias("room"))
    calls = few.join(early.select(*own, "n", "granted"), own, "left").join(room, "report_run", "left")
    asked = F.when(before | at, F.coalesce("n", F.lit(0))).otherwise(F.least(F.size("few"), F.coalesce("room", F.lit(per_run))))
    last = lambda n: F.when(n > 0, F.try_element_at("few", n.cast("int")))
    calls = calls.select(*own, last(F.coalesce("granted", F.lit(0))).alias("_granted"), last(asked).alias("_asked"))
    mine = F.struct("ord", "_row")
    code = F.when(~F.col("_valid"), "invalid_query").when(mine <= F.col("_granted"), F.lit(None)).when(mine <= F.col("_asked"), "global_query_cap_exceeded").otherwise("report_query_cap_exceeded")
    return rows.join(calls, own, "left").withColumn("failure_code", code).select("ord", *own, F.col("failure_code").isNull().alias("attempted"), "failure_code")


def call_status(queries: DataFrame) -> DataFrame:
    """ok, partial_failure or failure per call."""
    bad = F.count_if(F.col("failure_code").isNotNull())
    return queries.groupBy("report_run", "call_id").agg(F.count("*").alias("queries"), bad.alias("failed"), F.when(bad == 0, "ok").when(bad < F.count("*"), "partial_failure").otherwise("failure").alias("status"))


def match_search_log(trace: DataFrame, log: DataFrame) -> DataFrame:
    """The k-th use of a query text in a run takes the k-th log record of that text. trace(report_run, ord, query), log(report_run, query_sequence, query, status)."""
    k = lambda order: F.row_number().over(Window.partitionBy("report_run", "query").orderBy(order))
    return trace.withColumn("k", k("ord")).join(log.withColumn("k", k("query_sequence")), ["report_run", "query", "k"], "left").select("report_run", "ord", "query", "query_sequence", "status")


def run_ledger(snapshots: DataFrame, cap: int = 7) -> DataFrame:
    """The latest snapshot per run and whether its counts hold: 0 <= successful <= attempted <= cap.
    snapshots(run_id, version, queries_attempted, queries_successful)."""
    latest = snapshots.groupBy("run_id").agg(F.max_by(F.struct("version", "queries_attempted", "queries_successful"), "version").alias("s")).select("run_id", "s.*")
    holds = (F.col("queries_successful") >= 0) & (F.col("queries_successful") <= F.col("queries_attempted")) & (F.col("queries_attempted") <= cap)
    return latest.withColumn("consistent", holds)
