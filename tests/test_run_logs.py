"""Event logs, batch and stream, against a plain walk over the events; ledgers, captured texts, caps and sources."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from stagesignal.operators import trace
from stagesignal.streaming import decisions

SOURCE = "struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>"
EVENT = "report_run string, ord long, ts timestamp, event string, call_id string, id string, parent_ids array<string>, topic_text string, topic_id string, queries array<string>, output string, input_tokens long, output_tokens long, prompt_tokens long, completion_tokens long"
LOG = f"report_run string, ord long, ts timestamp, query_sequence long, query string, attempted boolean, status string, failure_code string, sources array<{SOURCE}>"
FIELDS = [f.split()[0] for f in ("report_run", "ord", "ts", "event", "call_id", "id", "parent_ids", "topic_text", "topic_id", "queries", "output", "input_tokens", "output_tokens", "prompt_tokens", "completion_tokens")]


def at(ord_):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=ord_)


def event(ord_, name, call=None, run="r", **more):
    row = dict.fromkeys(FIELDS) | {"report_run": run, "ord": ord_, "ts": at(ord_), "event": name, "call_id": call, "id": f"e{ord_}", "parent_ids": [], "topic_id": "topic_001"} | more
    return tuple(row[f] for f in FIELDS)


def record(ord_, query, run="r", status="ok", code=None, link="https://a.example/"):
    return (run, ord_, at(ord_), ord_, query, status == "ok", status, code, [(None, "t", link, "a.example", 1, None)] if link else [])


def walked(events, log):
    """The queries of a run log, event by event."""
    rows, open_calls, numbers, held = {}, {}, {}, {}
    for r in sorted([(e[1], 1, e) for e in events] + [(x[1], 0, x) for x in log], key=lambda r: r[:2]):
        if r[1] == 0:
            held.setdefault((r[2][0], r[2][4]), []).append(r[2])
            continue
        e = dict(zip(FIELDS, r[2]))
        key = (e["report_run"], e["call_id"] or "")
        if e["event"] == "tool_start":
            open_calls[key] = []
            for q in e["queries"] or []:
                topic = (e["report_run"], e["topic_id"])
                numbers[topic] = numbers.get(topic, 0) + 1
                name = (e["report_run"], f"{e['topic_id']}_query_{numbers[topic]:03d}")
                open_calls[key].append(name)
                rows[name] = [q, True, "failure", "trace_incomplete_tool_call", ()]
        elif key in open_calls and e["event"] in ("tool_end", "tool_error"):
            names = open_calls[key]
            asked = [rows[n][0] if n not in rows or len(rows[n]) == 5 else rows[n][5] for n in names]
            if e["event"] == "tool_error":
                for n, q in zip(names, asked):
                    rows[n] = [q, True, "failure", "tool_execution_error", (), q]
                continue
            found = []
            for q in asked:
                left = held.get((e["report_run"], q), [])
                x = left.pop(0) if left else None
                found.append(x and {"query": x[4], "attempted": x[5], "status": x[6], "failure_code": x[7], "links": tuple(s[2] for s in x[8])})
            if not any(found):
                try:
                    told = json.loads(e["output"] or "").get("queries")
                except ValueError:
                    told = None
                found = [{"links": tuple(s.get("link", "") for s in x.get("sources") or [])} | x for x in told] if told else found
            for k, (n, q) in enumerate(zip(names, asked)):
                x = found[k] if k < len(found) else None
                rows[n] = [x.get("query") or q, bool(x.get("attempted")), "ok" if x.get("status") == "ok" else "failure", x.get("failure_code"), x["links"], q] if x else [q, True, "failure", "trace_missing_query_result", (), q]
    return sorted((*n, *v[:5]) for n, v in rows.items())


def random_log(seed, n=160):
    draw = random.Random(seed)
    events, log = [], []
    for k in range(n):
        run, call, kind = draw.choice("rs"), draw.choice(["a", "b", "c", None]), draw.choice(["tool_start", "tool_start", "tool_end", "tool_end", "tool_error", "chain_start"])
        queries = [draw.choice(["tea", "pot", "cup"]) for _ in range(draw.randrange(4))]
        output = draw.choice([None, "words", '{"x": 1}', json.dumps({"queries": [{"query": "told", "attempted": True, "status": "ok", "sources": [{"link": "https://o.example/"}]}, {"status": "odd", "failure_code": "c"}]})])
        events.append(event(2 * k, kind, call, run, topic_id=draw.choice(["topic_001", "topic_002"]), queries=queries if kind == "tool_start" else None, output=output if kind == "tool_end" else None))
        if draw.random() < 0.4:
            log.append(record(2 * k + 1, draw.choice(["tea", "pot"]), run, draw.choice(["ok", "failure", "odd"]), draw.choice([None, "empty_organic"]), draw.choice([None, f"https://a.example/{k}"])))
    return events, log


def plain(df):
    return sorted((r["report_run"], r["query_id"], r["query"], r["attempted"], r["status"], r["failure_code"], tuple(s["link"] for s in r["sources"])) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_search_calls_are_those_of_a_walk(spark, seed):
    events, log = random_log(seed)
    got = trace.pair_tool_calls(spark.createDataFrame(events, EVENT).repartition(3), spark.createDataFrame(log, LOG))
    assert plain(got) == walked(events, log)
    assert trace.pair_tool_calls(spark.createDataFrame([], EVENT), spark.createDataFrame([], LOG)).count() == 0


def test_search_calls_without_a_log(spark):
    rows = [event(0, "tool_start", "a", queries=["x", "y"]), event(1, "tool_end", "a", output="plain"), event(2, "tool_start", "b", queries=["z"]), event(3, "tool_end", "b", output='{"queries": [{"query": "z", "attempted": true, "status": "ok"}]}'), event(4, "tool_start", "c", queries=["w"]), event(5, "tool_end", "c", output='{"n": 1}')]
    got = {r["query_id"]: (r["status"], r["failure_code"]) for r in trace.pair_tool_calls(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"topic_001_query_001": ("failure", "unstructured_search_output"), "topic_001_query_002": ("failure", "unstructured_search_output"), "topic_001_query_003": ("ok", None), "topic_001_query_004": ("failure", "trace_missing_query_result")}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, held)


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, rocks):
    """Files in mixed order within the lateness, restarts between them, open calls closed at the end."""
    events, log = random_log(3, 90)
    told = spark.createDataFrame(events, EVENT).select("report_run", "ord", "ts", "event", "call_id", "topic_id", "queries", "output", F.lit(None).cast(f"struct<query: string, attempted: boolean, status: string, failure_code: string, sources: array<{SOURCE}>>").alias("record"))
    logged = spark.createDataFrame(log, LOG).select("report_run", "ord", "ts", F.lit("search_record").alias("event"), F.struct("query", "attempted", "status", "failure_code", "sources").alias("record"))
    every = told.unionByName(logged, allowMissingColumns=True).where("event <> 'chain_start'")
    late = spark.range(1).select(F.lit("none").alias("report_run"), F.lit(0).cast("long").alias("ord"), F.lit(at(10**5)).cast("timestamp").alias("ts"), F.lit("none").alias("event"))
    steps = [every.where(f"ord < 90 and ord % 3 = {k}") for k in (1, 0, 2)] + [every.where("ord >= 90"), every.limit(0).unionByName(late, allowMissingColumns=True)]
    for k, part in enumerate(steps):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"step={k}"))
        stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in" / "step=*"))
        out = decisions.run_to_files(decisions.stream_tool_calls(stream, late="3 hours", idle="10 days"), "append", str(tmp_path / "out"))
    assert plain(decisions.latest_calls(out)) == walked(events, log)


def test_topics(spark):
    rows = [event(0, "chain_start", topic_text="A"), event(1, "chain_start", topic_text="B"), event(2, "chain_start", topic_text="A"), event(3, "tool_start", "a", parent_ids=["e0", "e1"]), event(4, "tool_start", "b", parent_ids=["zz"]), event(5, "tool_start", "b", parent_ids=["e1", "zz"]), event(6, "tool_end", "b", parent_ids=None)]
    topics = {r["ord"]: r["topic_id"] for r in trace.assign_topics(spark.createDataFrame(rows, EVENT)).collect()}
    assert [topics[k] for k in range(7)] == ["topic_001", "topic_002", "topic_001", "topic_002", "topic_unmapped", "topic_002", "topic_unmapped"]


def test_tokens_count_once_per_call_by_its_first_usage(spark):
    rows = [event(0, "model_end", "c1"), event(1, "model_end", "c1", input_tokens=40, output_tokens=10), event(2, "model_end", "c1", input_tokens=99), event(3, "model_end", None, input_tokens=7), event(4, "model_end", "", input_tokens=9),
            event(5, "model_end", "c2", input_tokens=0, prompt_tokens=5, completion_tokens=3), event(6, "tool_end", "c3", input_tokens=1)]
    got = trace.token_ledger(spark.createDataFrame(rows, EVENT)).collect()
    assert [tuple(r) for r in got] == [("r", 45, 13, 2, 58)]


def test_running_tokens(spark, tmp_path):
    df = spark.createDataFrame([event(k, "model_end", f"m{k % 5}" if k else None, input_tokens=10 if k != 1 else None, output_tokens=1 if k != 1 else None) for k in range(12)], EVENT)
    for k in range(2):
        df.where(F.col("ord") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"step={k}"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "step=*"))
        out = decisions.run_to_files(decisions.model_tokens(stream, "1 hour"), "update", str(tmp_path / "out"))
    last = out.groupBy("report_run").agg(F.max_by(F.struct("input_tokens", "output_tokens", "token_usage_events"), "batch").alias("s")).select("s.*").collect()
    assert [tuple(r) for r in last] == [(50, 5, 5)]


def test_captured_texts(spark):
    bad = "Error generating final report: x"
    rows = [("r", 0, "report", " first ", False), ("r", 1, "report", "second", False), ("s", 0, "report", "early", False), ("s", 1, "report", " last of the node ", True), ("s", 2, "report", bad, True), ("s", 3, "report", "later", False), ("t", 0, "report", bad, True),
            ("t", 1, "report", "good", False), ("r", 5, "compressed topic_001", "Error bars are wide", False), ("r", 6, "compressed topic_001", bad, False), ("r", 7, "brief", "Error synthesizing research report: kept\n", False), ("r", 8, "brief", " \n", False)]
    got = {(r["report_run"], r["slot"]): r["text"] for r in trace.capture_latest(spark.createDataFrame(rows, "report_run string, ord long, slot string, text string, is_final boolean")).collect()}
    assert got == {("r", "report"): "first", ("s", "report"): "last of the node", ("t", "report"): "good", ("r", "compressed topic_001"): "Error bars are wide", ("r", "brief"): "Error synthesizing research report: kept"}


def test_outcomes_of_queries(spark):
    item = "struct<title: string, link: string, position: int, snippet: string>"
    rows = [(0, None), (1, []), (2, [("t", "ftp://a.example/", 1, "s")]), (3, [(" T ", "HTTPS://u:p@A.example:80", 0, " s ")]), (4, [("t", "https://a.example:80/#x", 4, "s")]), (5, [("t", None, 1, "s"), ("t", "x", 1, "s"), ("t", "y", 1, "s"), ("t", "https://b.example/", 1, "s")])]
    responses = spark.createDataFrame([("r", k, "q", o) for k, o in rows], f"report_run string, query_sequence long, query string, organic array<{item}>")
    chosen = trace.select_sources(responses)
    codes = {r["query_sequence"]: r["failure_code"] for r in trace.query_outcomes(responses, chosen).collect()}
    assert codes == {0: "empty_organic", 1: "empty_organic", 2: "malformed_organic", 3: None, 4: "no_new_sources", 5: "malformed_organic"}
    assert [tuple(r) for r in chosen.collect()] == [("r", 3, 0, "q", "T", "https://a.example:80/", "a.example:80", 1, "s", 1)]


def walked_caps(requests, per_call, per_run, overall):
    calls, had, total, out = {}, {}, 0, []
    for k, (o, run, call, q) in sorted(enumerate(requests), key=lambda x: (x[1][0], x[0])):
        calls.setdefault((run, call), []).append((o, k, q))
    firsts = {c: min((o for o, _, q in rows if q and q.strip()), default=None) for c, rows in calls.items()}
    for (run, call), rows in sorted(calls.items(), key=lambda c: (firsts[c[0]] is None, firsts[c[0]], c[0][1], c[0][0])):
        valid = [r for r in rows if r[2] and r[2].strip()]
        asked = valid[: max(0, min(per_run - had.get(run, 0), per_call))]
        granted = asked[: max(0, overall - total)]
        had[run], total = had.get(run, 0) + len(granted), total + len(granted)
        out += [(k, None if r in granted else "global_query_cap_exceeded" if r in asked else "report_query_cap_exceeded" if r in valid else "invalid_query") for r in rows for k in [r[1]]]
    return [c for _, c in sorted(out)]


@pytest.mark.parametrize("overall", [0, 1, 7, 40, 10**6])
def test_caps_are_those_of_a_walk(spark, overall, monkeypatch):
    monkeypatch.setattr(trace, "BLOCK", 4)
    draw = random.Random(overall)
    rows = [(draw.choice([k, k // 2 * 2]), f"r{draw.randrange(6)}", f"c{k // 4}", draw.choice(["q", "q", "q", " ", None])) for k in range(200)]
    got = trace.admit_queries(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "ord long, report_run string, call_id string, query string, k long").coalesce(1), 2, 7, overall)
    counted = sorted((r["ord"], r["report_run"], r["call_id"], r["failure_code"] or "") for r in got.collect())
    assert counted == sorted((*r[:3], c or "") for r, c in zip(rows, walked_caps(rows, 2, 7, overall)))
    assert got.where("attempted <> (failure_code is null)").count() == 0


def test_requests_with_one_arrival_number(spark):
    rows = spark.createDataFrame([(0, "r", "c", "q")] * 3, "ord long, report_run string, call_id string, query string")
    assert trace.admit_queries(rows, per_call=1).where("attempted").count() == 1
