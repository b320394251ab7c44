"""Search mechanism, source stability and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagesignal.functions.scalars import SEARCH_STOP, URL_RULES, certainty_proxy, is_generic, normalize_query, normalize_url, tokens, url_category, url_host
from stagesignal.operators.stats import cluster_bootstrap_means


#: Rows of a task that counts a run's items.
RUN_ROWS = 200_000
#: Kinds of what is counted.
QUERY, HOST, TOKEN, BRIEF = range(4)


def _by_run(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with those of a run in one task, in tasks by the number of rows of `of`: what is made of the rows after that needs no
    further exchange, and a task's counts fit its memory."""
    return rows.repartition(max(1, -(-of.select("run").count() // RUN_ROWS)), "run")


def search_mechanism_rows(trace: DataFrame, briefs: DataFrame | None = None) -> DataFrame:
    """One wide row per run of trace(run, query, link), attempted or not: query counts and those of different queries as
    written, characters, entropy and type-token ratio of the query tokens, entropy of those of briefs(run, text), generic
    share, hosts, shares of link categories and their entropy. Blank queries and missing links do not count.

    Queries and briefs travel once, as they are. Behind that exchange they become tagged rows (kind, value): queries, hosts and
    tokens are counted per run by one aggregation, a second one sums the counts of each kind, and a third makes the run's row."""
    blank = F.lit(None).cast("string")
    host = F.when(F.coalesce("link", F.lit("")) != "", url_host(F.trim("link")))  # normalising the link would leave its host as it is
    query = F.nullif(F.btrim("query", F.lit(" \t\n\x0b\f\r")), F.lit(""))
    rows = trace.select("run", query.alias("query"), host.alias("host"), blank.alias("brief"))
    if briefs is not None:
        rows = rows.unionByName(briefs.select("run", blank.alias("query"), blank.alias("host"), F.col("text").alias("brief")))
    told = F.posexplode(F.concat(F.array("query", "host"), tokens(F.coalesce("query", "brief")))).alias("pos", "value")
    tagged = _by_run(rows, trace).select("run", F.col("brief").isNotNull().alias("of_brief"), told)
    tagged = tagged.where((F.col("pos") == 0) | ((F.col("pos") == 1) & F.col("value").isNotNull()) | ((F.col("pos") > 1) & (F.length("value") > 2) & ~F.col("value").isin(*SEARCH_STOP)))
    kind = F.when(F.col("value").isNull(), None).when(F.col("pos") == 0, QUERY).when(F.col("pos") == 1, HOST).when(F.col("of_brief"), BRIEF).otherwise(TOKEN)
    counts = tagged.select("run", kind.alias("kind"), "value").groupBy("run", "kind", "value").agg(F.count("*").alias("n"))
    n, asked = F.col("n"), F.col("kind") == QUERY
    sums = counts.withColumn("category", F.when(F.col("kind") == HOST, url_category(F.col("value")))).groupBy("run", "kind", "category").agg(
        F.count("*").alias("different"), F.sum("n").alias("n"), F.sum(n * F.log2("n")).alias("logs"), F.sum(F.when(asked, n * F.length("value"))).alias("chars"), F.sum(F.when(asked & is_generic(F.col("value")), n)).alias("generic"))

    def total(kind: int, c: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))

    def bits(kind: int) -> Column:  # log2 of the total less the mean of log2 n, weighted by n
        return F.round(F.coalesce(F.log2(F.nullif(total(kind), F.lit(0))) - total(kind, "logs") / F.nullif(total(kind), F.lit(0)), F.lit(0.0)), 5)

    different = lambda kind: total(kind, "different")
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)
    names = [*(n for n, _ in URL_RULES), "other_web", "unknown"]
    of = {c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)) for c in names}
    out = sums.groupBy("run").agg(
        total(QUERY).alias("queries"), different(QUERY).alias("unique_queries"), share(different(QUERY), total(QUERY)).alias("unique_ratio"), total(QUERY, "chars").alias("chars"),
        share(total(QUERY, "chars"), total(QUERY)).alias("mean_query_chars"), share(total(QUERY, "generic"), total(QUERY)).alias("generic_rate"),
        different(HOST).alias("hosts"), *[share(n, total(HOST)).alias(f"share_{c}") for c, n in of.items()],
        bits(TOKEN).alias("entropy"), share(different(TOKEN), total(TOKEN)).alias("type_token_ratio"), different(TOKEN).alias("unique_tokens"), total(TOKEN).alias("token_count"), bits(BRIEF).alias("brief_entropy"))
    # The entropy of the categories' shares as whole per cents, one at least for each.
    whole = F.filter(F.array(*[F.when(F.col(f"share_{c}") > 0, F.greatest(F.lit(1.0), F.round(100 * F.col(f"share_{c}")))) for c in names]), lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("logs"))
    spread = F.aggregate(whole, start, lambda t, x: F.struct((t["sum"] + x).alias("sum"), (t["logs"] + x * F.log2(x)).alias("logs")), lambda t: F.log2(F.nullif(t["sum"], F.lit(0.0))) - t["logs"] / t["sum"])
    return out.withColumn("category_entropy", F.round(F.coalesce(spread, F.lit(0.0)), 5))


def bucket_retention(queries: DataFrame, briefs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per run and profile bucket: the share of the bucket's tokens that the brief has, that the queries have, and what is
    lost between the two. queries(run, query), briefs(run, text), buckets(run, bucket, tokens), of one bucket in any number of rows.
    All travel once; behind that exchange each token of a run is told which buckets, briefs and queries have it."""
    told = lambda df, kind, text, toks, bucket: df.select("run", F.lit(kind).alias("kind"), text.alias("text"), toks.alias("toks"), bucket.alias("bucket"))
    none, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    rows = told(buckets, "bucket", no_text, F.array_distinct("tokens"), F.col("bucket"))
    rows = rows.unionByName(told(briefs, "brief", F.col("text"), none, F.lit(None))).unionByName(told(queries, "query", F.col("query"), none, F.lit(None)))
    found = _by_run(rows, queries).select("run", "kind", "bucket", F.explode(F.concat("toks", tokens(F.col("text")))).alias("t"))
    found = found.where((F.col("kind") == "bucket") | ((F.length("t") > 2) & ~F.col("t").isin(*SEARCH_STOP)))
    has = lambda kind: F.max(F.col("kind") == kind)
    per = found.groupBy("run", "t").agg(F.collect_set("bucket").alias("buckets"), has("brief").alias("b"), has("query").alias("q"))
    per = per.select("run", F.explode("buckets").alias("bucket"), "b", "q").groupBy("run", "bucket").agg(F.count("*").alias("tokens"), F.count_if("b").alias("b"), F.count_if("q").alias("q"))
    return per.select("run", "bucket", "tokens", F.round(F.col("b") / F.col("tokens"), 6).alias("brief"), F.round(F.col("q") / F.col("tokens"), 6).alias("query"), F.round((F.col("b") - F.col("q")) / F.col("tokens"), 6).alias("lost"))


def bucket_summary(retention: DataFrame, correct: DataFrame) -> DataFrame:
    """Mean retention per bucket, over all runs and those with a right and a wrong search. correct(run, search_correct)."""
    rows = retention.join(correct, "run").select(_outcome(), "bucket", "brief", "query", "lost")
    return rows.groupBy("scope", "bucket").agg(F.count("*").alias("runs"), *[F.round(F.avg(c), 4).alias(c) for c in ("brief", "query", "lost")])


def certainty_by_stage(matches: DataFrame) -> DataFrame:
    """Mean certainty of the matcher's reasoning per stage, and accuracy. matches(stage, reasoning, correct)."""
    rows = matches.select("stage", F.col("correct").cast("int").alias("h"), certainty_proxy(F.coalesce("reasoning", F.lit(""))).alias("c"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy("stage").agg(F.count("*").alias("n"), mean("c.score", "certainty"), mean(F.col("c.has_strong").cast("int"), "has_strong"), mean(F.col("c.has_hedge").cast("int"), "has_hedge"), mean("c.named", "named"), mean("h", "accuracy"))


def _outcome() -> Column:
    return F.explode(F.array(F.lit("all"), F.when(F.col("search_correct"), "search_correct").otherwise("search_wrong"))).alias("scope")


SUMMED = ("queries", "unique_queries", "unique_ratio", "mean_query_chars", "unique_tokens", "entropy", "type_token_ratio", "generic_rate", "hosts", "share_retail_books", "share_academic", "share_course_platform")


def search_mechanism_summary(rows: DataFrame, correct: DataFrame) -> DataFrame:
    """Means over all runs, over those with a right and a wrong search, and right less wrong. correct(run, search_correct)."""
    joined = rows.join(correct, "run")
    means = joined.select(_outcome(), *SUMMED).groupBy("scope").agg(F.count("*").alias("runs"), *[F.round(F.avg(c), 4).alias(c) for c in SUMMED])
    part = lambda ok, c: F.avg(F.when(F.col("search_correct") == ok, F.col(c)))
    return means.union(joined.agg(F.lit("right_less_wrong").alias("scope"), F.count("*").alias("runs"), *[F.round(part(True, c) - part(False, c), 4).alias(c) for c in SUMMED]))


def recovery_cases(rows: DataFrame, retention: DataFrame, outcomes: DataFrame, bucket: str, n: int = 5) -> DataFrame:
    """The report of the n runs right at plan and write and wrong at search that were most generic, then lost most of a
    bucket, then asked longest; ties by run. outcomes(run, plan, search, write) are 0 or 1."""
    lost = retention.where(F.col("bucket") == bucket).select("run", "lost")
    found = outcomes.where("plan = 1 and search = 0 and write = 1").join(rows, "run").join(lost, "run", "left").na.fill(0.0, ["lost"])
    return found.select("run", "generic_rate", "lost", "mean_query_chars").orderBy(F.desc("generic_rate"), F.desc("lost"), F.desc("mean_query_chars"), "run").limit(n)


def top_cases(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The report of the n runs with the highest value, ties by run."""
    return rows.orderBy(F.desc(by), "run").limit(n)


def overlap_items(trace: DataFrame, kind: str) -> DataFrame:
    """Different items (normalised queries or URLs) of attempted queries, per task, user and seed."""
    item = normalize_query(F.col("query")) if kind == "queries" else normalize_url(F.col("link"))
    return trace.where("attempted").select("taskid", "userid", "seed", item.alias("item")).where("item is not null").distinct()


def source_stability(trace: DataFrame, units: DataFrame, kind: str) -> DataFrame:
    """Per task: mean Jaccard of one user's items across seeds, and of different users' within a seed, and the difference.
    units(taskid, userid, seed) is the grid: a task in which a user lacks a seed that another has, or with a single user, is an
    error. Two empty sets overlap by 1. Overlaps are counted through the items."""
    grid = units.groupBy("taskid").agg(F.count_distinct("userid", "seed").alias("units"), F.count_distinct("userid").alias("users"), F.count_distinct("seed").alias("seeds"))
    whole = (F.col("users") > 1) & (F.col("units") == F.col("users") * F.col("seeds"))
    checked = grid.select(F.when(whole, F.col("taskid")).otherwise(F.raise_error(F.concat(F.lit("incomplete task: "), F.col("taskid").cast("string"))).cast(units.schema["taskid"].dataType)).alias("taskid"))
    items = overlap_items(trace, kind)
    sizes = units.join(items.groupBy("taskid", "userid", "seed").agg(F.count("*").alias("n")), ["taskid", "userid", "seed"], "left").na.fill(0, ["n"])
    a, b = (sizes.select("taskid", F.col("userid").alias(f"u{k}"), F.col("seed").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    wanted = ((F.col("ua") == F.col("ub")) & (F.col("sa") < F.col("sb"))) | ((F.col("ua") < F.col("ub")) & (F.col("sa") == F.col("sb")))
    pairs = a.join(b, "taskid").where(wanted)  # users of one task: a handful
    x, y = (items.select("taskid", "item", F.col("userid").alias(f"u{k}"), F.col("seed").alias(f"s{k}")) for k in "ab")
    keys = ["taskid", "ua", "sa", "ub", "sb"]
    shared = x.join(y, ["taskid", "item"]).where(wanted).groupBy(*keys).agg(F.count("*").alias("shared"))
    scored = pairs.join(shared, keys, "left").na.fill(0, ["shared"])
    union = F.col("na") + F.col("nb") - F.col("shared")
    scored = scored.select("taskid", (F.col("ua") == F.col("ub")).alias("same"), F.when(union > 0, F.col("shared") / union).otherwise(1.0).alias("j"))
    per = scored.groupBy("taskid").agg(F.avg(F.when(F.col("same"), F.col("j"))).alias("within"), F.avg(F.when(~F.col("same"), F.col("j"))).alias("between"),
                                       F.count_if("same").alias("within_pairs"), F.count_if(~F.col("same")).alias("between_pairs"))
    return checked.join(per, "taskid").select("taskid", F.round("within", 6).alias("within"), F.round("between", 6).alias("between"), F.round(F.col("within") - F.col("between"), 6).alias("difference"), "within_pairs", "between_pairs")


def stability_means(per_task: DataFrame) -> DataFrame:
    """Over all tasks: their number and the means of what they have, each task counting once, and the pairs."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return per_task.agg(F.count("*").alias("tasks"), mean("within"), mean("between"), mean("difference"), F.sum("within_pairs").alias("within_pairs"), F.sum("between_pairs").alias("between_pairs"))


def stability_interval(per_task: DataFrame, reps: int = 5000) -> DataFrame:
    """The mean difference over tasks with its interval."""
    return cluster_bootstrap_means(per_task.where("difference is not null"), "taskid", F.col("difference"), reps=reps)


def source_diversity(trace: DataFrame) -> DataFrame:
    """Per task: members, union of URLs, URLs of one member only and of all, their share, mean URLs per member, and the mean
    over pairs of members of the URLs that both have, as a share of the mean per member (null for one member)."""
    items = trace.where("attempted").select("taskid", "userid", normalize_url(F.col("link")).alias("url")).distinct()
    members = items.groupBy("taskid").agg(F.count_distinct("userid").alias("members"), F.count("*").alias("total"))
    urls = items.groupBy("taskid", "url").agg(F.count("*").alias("k")).join(members, "taskid")
    out = urls.groupBy("taskid", "members", "total").agg(F.count("*").alias("union"), F.count_if(F.col("k") == 1).alias("single"), F.count_if(F.col("k") == F.col("members")).alias("common"),
                                                         F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("pairwise_shared"))
    overlap = F.try_divide(2 * F.col("pairwise_shared"), (F.col("members") - 1) * F.col("total"))
    return out.select("*", F.round(F.col("single") / F.col("union"), 6).alias("unique_fraction"), F.round(F.col("total") / F.col("members"), 6).alias("mean_per_member"),
                      F.round(overlap, 6).alias("mean_overlap"), F.round(1 - overlap, 6).alias("mean_apart")).drop("total")
