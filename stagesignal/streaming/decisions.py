"""Structured Streaming over decisions and events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def running_accuracy(stream: DataFrame, watermark: str | None = "1 day", time_col: str = "ts") -> DataFrame:
    """Stage accuracy over a stream of decisions, each run and stage counted once. The state of duplicates is dropped as the
    watermark passes; with None, for streams without a time or that end, it is kept for good."""
    keys = ["run_id", "stage"]
    once = stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(keys) if watermark else stream.dropDuplicates(keys)
    return once.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("correct"))


def model_tokens(stream: DataFrame, watermark: str, time_col: str = "ts") -> DataFrame:
    """Tokens per run over a stream of model ends, each call counted once within the watermark: its first event with usage."""
    used = "event = 'model_end' and coalesce(call_id, '') <> '' and coalesce(input_tokens, output_tokens) is not null"
    once = stream.where(used).withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["report_run", "call_id"])
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return once.groupBy("report_run").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), F.count("*").alias("token_usage_events"))


CALL_ROWS = "report_run string, call_id string, query_id string, topic_id string, query string, attempted boolean, status string, failure_code string, sources string, at long"
_SOURCE = ("query", "title", "link", "domain", "rank", "snippet")


class _SearchCalls(StatefulProcessor):
    """A run's search calls: events wait until the watermark has passed them, so they are taken in the order of time however
    they arrive. A start opens its queries, a record of the search log waits for the first use of its text, an end claims
    records, an error fails its queries; once nothing came for idle ms, what is open is closed as incomplete.

    A text's records are a queue, an entry of the state for each. What the due events touch is read once, changed in memory and
    written once, so the work grows with the events, however many records wait."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, ord long, event string, call_id string, topic_id string, queries string, output string, record string")
        self.calls = handle.getMapState("calls", "call_id string", "call string")
        self.log = handle.getMapState("log", "query string, n long", "record string")
        self.ends = handle.getMapState("ends", "query string", "first long, next long")
        self.numbers = handle.getMapState("numbers", "topic_id string", "n long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest, new = (self.last.get() or (0,))[0], []
        for batch in rows:
            for r in batch.itertuples(index=False):
                new.append((int(r.ms), int(r.ord), *(None if v is None or v != v else v for v in (r.event, r.call_id, r.topic_id, r.queries, r.output, r.record))))
        self.waiting.appendList(new)
        newest = max(r[0] for r in new)
        if newest > latest:
            self.last.update((newest,))
        self.handle.registerTimer(newest)
        self.handle.registerTimer(newest + self.idle)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        self._opened, self._counts, self._queues, self._fresh = {}, {}, {}, {}
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[1], r[2] != "search_record"))
        if due:
            rest = [r for r in held if r[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        for _, order, event, call_id, topic, queries, output, record in due:
            self._take(key[0], order, event, call_id or "", topic or "topic_unmapped", json.loads(queries or "[]"), output, record, out)
        self._store()
        if self.last.exists() and now >= self.last.get()[0] + self.idle and len(due) == len(held):
            for call_id, call in list(self.calls.iterator()):
                opened = json.loads(call[0])
                out += [] if opened["settled"] else [(key[0], opened["call_id"], i, t, q, True, "failure", "trace_incomplete_tool_call", "[]", None) for i, t, q in opened["queries"]]
            for state in (self.waiting, self.calls, self.log, self.ends, self.numbers, self.last):
                state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CALL_ROWS.split(", ")])

    def _take(self, run: str, order: int, event: str, call_id: str, topic: str, queries: list, output: str | None, record: str | None, out: list) -> None:
        if event == "search_record":
            text = json.loads(record)["query"]
            ends = self._queue(text)
            self._fresh[text, ends[1]] = record
            ends[1] += 1
        elif event == "tool_start":
            earlier = self._call(call_id)
            if earlier and not earlier["settled"]:  # the same id again: the earlier call can no longer end
                self._opened[f"{call_id}\0{order}"] = earlier
            if topic not in self._counts:
                self._counts[topic] = (self.numbers.getValue((topic,)) or (0,))[0]
            n = self._counts[topic]
            ids = [(f"{topic}_query_{n + k:03d}", topic, "None" if q is None else q) for k, q in enumerate(queries, 1)]
            self._counts[topic] = n + len(ids)
            self._opened[call_id] = {"call_id": call_id, "settled": False, "queries": ids}
        elif opened := self._call(call_id):
            opened["settled"] = True
            found = [self._claim(q) for _, _, q in opened["queries"]] if event == "tool_end" else []
            if event == "tool_end" and not any(found):
                found = _records(output) or found
            for k, (i, t, q) in enumerate(opened["queries"]):
                r = found[k] if k < len(found) else None
                if event == "tool_error" or r is None:
                    out.append((run, call_id, i, t, q, True, "failure", "tool_execution_error" if event == "tool_error" else "trace_missing_query_result", "[]", order))
                    continue
                text = q if r.get("query") is None else r["query"]
                sources = [{c: s.get(c) if c == "rank" else text if c == "query" and s.get(c) is None else s.get(c) or "" for c in _SOURCE} for s in r.get("sources") or []]
                out.append((run, call_id, i, t, text, bool(r.get("attempted")), "ok" if r.get("status") == "ok" else "failure", r.get("failure_code"), json.dumps(sources), order))

    def _call(self, call_id: str) -> dict | None:
        if call_id not in self._opened:
            held = self.calls.getValue((call_id,))
            self._opened[call_id] = json.loads(held[0]) if held else None
        return self._opened[call_id]

    def _queue(self, query: str) -> list[int]:
        """The numbers of a text's first record that waits and of the next to come."""
        if query not in self._queues:
            self._queues[query] = list(self.ends.getValue((query,)) or (0, 0))
        return self._queues[query]

    def _claim(self, query: str) -> dict | None:
        ends = self._queue(query)
        if ends[0] == ends[1]:
            return None
        at = (query, ends[0])
        ends[0] += 1
        record = self._fresh.pop(at, None)
        if record is None:
            record = self.log.getValue(at)[0]
            self.log.removeKey(at)
        return json.loads(record)

    def _store(self) -> None:
        for at, record in self._fresh.items():
            self.log.updateValue(at, (record,))
        for query, ends in self._queues.items():
            self.ends.updateValue((query,), tuple(ends))
        for topic, n in self._counts.items():
            self.numbers.updateValue((topic,), (n,))
        for name, call in self._opened.items():
            if call:
                self.calls.updateValue((name,), (json.dumps(call),))

    def close(self) -> None:
        pass


def _records(output: str | None) -> list:
    try:
        found = json.loads(output or "")
    except ValueError:
        return []
    return (found.get("queries") or []) if isinstance(found, dict) else []


def stream_tool_calls(events: DataFrame, late: str = "10 minutes", idle: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """The rows of trace.pair_tool_calls over a stream of a run log: events(report_run, ord, event, call_id, topic_id,
    queries, output, time) with the search log in it as events search_record (record: struct<query, attempted, status,
    failure_code, sources>). Events may come late and out of order by `late`; a run without any for `idle` is over, and
    what it left open is closed as incomplete. A query is given out when its call ends, anew if it ends again: `latest_calls`
    keeps the last. The session needs the RocksDB state store."""
    from pyspark.sql.types import StructType

    rows = events.select("report_run", F.unix_millis(F.col(time_col)).alias("ms"), "ord", "event", "call_id", "topic_id", F.to_json("queries").alias("queries"), "output", F.to_json("record").alias("record"), F.col(time_col).alias("_time"))
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("_time", late).groupBy("report_run").transformWithStateInPandas(_SearchCalls(gap), StructType.fromDDL(CALL_ROWS), "append", "EventTime")


def latest_calls(rows: DataFrame) -> DataFrame:
    """What stream_tool_calls gave out, a row per query, sources as an array."""
    columns = [c.split()[0] for c in CALL_ROWS.split(", ")]
    last = rows.groupBy("report_run", "query_id").agg(F.max_by(F.struct(*columns), F.coalesce("at", F.lit(-1))).alias("r")).select("r.*")
    return last.withColumn("sources", F.from_json("sources", "array<struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>>")).drop("at")


def run_to_files(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what its source has now; each batch becomes files of its own below folder, written anew if it is
    repeated after a failure. Returns all rows written so far with their batch. Going on later, it starts where it ended."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{folder}/rows")


def ledger_upsert(path: str, parts: int = 64, keep: int = 3):
    """A foreachBatch function that keeps the latest snapshot of each run below path, by parts of the run ids. A batch writes
    anew only the parts that it has runs of, and then a manifest: for each part, the batch that wrote it last. A batch that
    is repeated writes the same again, and no reader sees it before its manifest. Batches count from 0.

    What no manifest of the last `keep` batches names is removed after the manifest is written, so the disk holds the live
    rows and those superseded within `keep` batches, and a reader pinned to one of these (`ledger`) is not disturbed. A
    removal that fails is made up for by the next batch. keep is 2 at least: a repeated batch reads the one before."""
    if keep < 2:
        raise ValueError("keep must be 2 at least")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, F.pmod(F.xxhash64("run_id"), F.lit(parts)).cast("int")
        held = _manifest(spark, path, batch_id - 1) if batch_id else {}
        touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]  # parts at most
        old = [f"{path}/data/batch={held[p]}/part={p}" for p in touched if p in held]
        rows = batch.unionByName(spark.read.parquet(*old)) if old else batch
        latest = rows.groupBy("run_id").agg(F.max_by(F.struct(*batch.columns), "version").alias("s")).select("s.*", part.alias("part"))
        latest.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/batch={batch_id}")
        now = held | {p: batch_id for p in touched}
        spark.createDataFrame(sorted(now.items()), "part int, batch long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch_id}")
        if batch_id >= keep:
            _compact(spark, path, batch_id, keep)

    return upsert


def _compact(spark: SparkSession, path: str, batch_id: int, keep: int) -> None:
    """Removes what the manifests of the last keep batches do not name, and the manifests before them."""
    named = {(b, p) for k in range(batch_id - keep + 1, batch_id + 1) for p, b in _manifest(spark, path, k).items()}
    folder = spark._jvm.org.apache.hadoop.fs.Path
    store = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [int(f.getPath().getName().partition("=")[2]) for f in store.listStatus(folder(f"{path}/manifest"))]
    for gone in sorted(k for k in batches if k <= batch_id - keep):  # one, if no removal failed
        for p, b in _manifest(spark, path, gone).items():
            data = folder(f"{path}/data/batch={b}")
            if (b, p) not in named and store.exists(data):
                store.delete(folder(f"{path}/data/batch={b}/part={p}"), True)
                if not any(f.isDirectory() for f in store.listStatus(data)):
                    store.delete(data, True)
        store.delete(folder(f"{path}/manifest/batch={gone}"), True)


def _manifest(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    return {r["part"]: r["batch"] for r in spark.read.schema("part int, batch long").json(f"{path}/manifest/batch={batch_id}").collect()}


def ledger(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The ledger as a batch left it: one of the last that `ledger_upsert` keeps."""
    return spark.read.parquet(*[f"{path}/data/batch={b}/part={p}" for p, b in _manifest(spark, path, batch_id).items()])


def run_ledger_stream(snapshots: DataFrame, path: str, parts: int = 64, keep: int = 3) -> int:
    """Runs a stream of snapshots (run_id, version, ..) over what its source has now into the ledger below path; going on
    later, it starts where it ended. Returns the last batch."""
    snapshots.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(ledger_upsert(path, parts, keep)).start().awaitTermination()
    return max(r["batch"] for r in snapshots.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(f"{path}/manifest").select(F.regexp_extract("path", "batch=([0-9]+)", 1).cast("long").alias("batch")).collect())
