"""Lifecycle of each user's operations over an event stream, by state and timers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkquarry.store import shared_dir

FAILS, STARTS = "error", "view"
DELAY_MS, LIMIT_MS = 600_000, 86_400_000
FIELDS = ("n", "failures", "recoveries", "failed_recoveries", "timeouts", "active", "longest_us")
SCHEMA = "user_id long, state string, since_us long, " + ", ".join(f"{f} long" for f in FIELDS)
#: Events in one element of the list of waiting ones; each element is one message to the state store.
CHUNK = 4096
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunks(events: list[tuple]) -> list[tuple[list, list, list]]:
    """(us, event_id, event_type) of up to CHUNK events each, as three lists."""
    return [tuple(map(list, zip(*events[k : k + CHUNK]))) for k in range(0, len(events), CHUNK)]


class Lifecycle(StatefulProcessor):
    """One user. Events wait in a list, many to an element, until the watermark has passed them, so late and disordered ones are taken in order of (ts, event_id); what comes after the watermark is dropped by the engine.

    The state of a user is the last event's type. An error is a failure; the event after an error is a
    recovery, or a failed one if it is an error too. A view starts an operation that the next event
    ends; longest_us is the longest one ended within LIMIT_MS, and one not ended within it is a timeout,
    found by its own timer. active is 1 while an operation runs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, event_id array<long>, event_type array<string>")
        self.summary = handle.getValueState("summary", SCHEMA.replace("user_id long, ", "") + ", timed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.event_id, r.event_type) for r in rows]
        if new:
            self.waiting.appendList(chunks(new))
            # Fires once the watermark is past the first of them, for all it has passed.
            self.handle.registerTimer(max(min(r[0] for r in new) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        all_ = sorted((us, event_id is not None, event_id or 0, kind) for part in self.waiting.get() for us, event_id, kind in zip(*part))
        ready = [r for r in all_ if r[0] // 1000 < mark]
        rest = all_[len(ready) :]
        if (held := self.summary.get()) is not None:
            state, since, *counts, timed = held
            s = dict(zip(FIELDS, counts))
        else:
            state, since, timed, s = None, None, False, dict.fromkeys(FIELDS, 0)
        for us, _, _, kind in ready:
            if state == STARTS and not timed:
                if us - since > LIMIT_MS * 1000:
                    s["timeouts"] += 1
                else:
                    s["longest_us"] = max(s["longest_us"], us - since)
            if state == FAILS:
                s["failed_recoveries" if kind == FAILS else "recoveries"] += 1
            s["failures"] += kind == FAILS
            s["n"] += 1
            state, since, timed = kind, us, False
        limit = None if state != STARTS or timed else since // 1000 + LIMIT_MS
        if limit is not None and limit < mark:
            s["timeouts"] += 1
            timed, limit = True, None
        s["active"] = int(state == STARTS and not timed)
        if ready:
            if rest:
                self.waiting.put(chunks([(us, event_id if known else None, kind) for us, known, event_id, kind in rest]))
            else:
                self.waiting.clear()
        if state is not None:
            self.summary.update((state, since, *(int(s[f]) for f in FIELDS), timed))
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if limit is not None:
            self.handle.registerTimer(limit + 1)
        if state is None:
            return iter(())
        return iter([Row(user_id=key[0], state=state, since_us=since, **{f: int(s[f]) for f in FIELDS})])

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame) -> DataFrame:
    """events (event_id, user_id, event_type, ts), a stream -> the state of each user whenever it changes. Rows with a null user, type or ts are ignored."""
    rows = events.filter("user_id is not null and event_type is not null and ts is not null").withWatermark("ts", f"{DELAY_MS} milliseconds")
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "event_type")
    return rows.groupBy("user_id").transformWithState(statefulProcessor=Lifecycle(), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime")


def batch_lifecycles(events: DataFrame, mark_ms: int | None = None) -> DataFrame:
    """The same of a table by windows, for all events before the watermark mark_ms (the last event minus the delay, if none is given)."""
    rows = events.filter("user_id is not null and event_type is not null and ts is not null").select("user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type")
    mark = F.lit(mark_ms).cast("long") if mark_ms is not None else F.col("mark")
    if mark_ms is None:
        last = rows.agg((F.expr("max(us) div 1000") - DELAY_MS).alias("mark"))
        rows = rows.join(F.broadcast(last))  # one row
    rows = rows.withColumn("mark", mark).filter("us div 1000 < mark")
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = rows.withColumn("before", F.lag("event_type").over(own)).withColumn("next", F.lead("us").over(own))
    kind, took = F.col("event_type"), F.col("next") - F.col("us")
    runs = (kind == STARTS) & F.col("next").isNull() & (F.expr("us div 1000") + LIMIT_MS >= F.col("mark"))
    late = (kind == STARTS) & F.when(F.col("next").isNull(), F.expr("us div 1000") + LIMIT_MS < F.col("mark")).otherwise(took > LIMIT_MS * 1000)
    return rows.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("us", "event_id")).alias("state"), F.max("us").alias("since_us"), F.count("*").alias("n"), F.count_if(kind == FAILS).alias("failures"),
        F.count_if((F.col("before") == FAILS) & (kind != FAILS)).alias("recoveries"), F.count_if((F.col("before") == FAILS) & (kind == FAILS)).alias("failed_recoveries"),
        F.count_if(late).alias("timeouts"), F.count_if(runs).alias("active"), F.coalesce(F.max(F.when((kind == STARTS) & (took <= LIMIT_MS * 1000), took)), F.lit(0)).alias("longest_us"))


def stream_of(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A parquet table, or one file of it, as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = name.endswith(".parquet") and "." in name
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name if one else "*.parquet")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder if one else path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], root: str) -> None:
    """All that is there now, in update mode, with state in RocksDB under root. The setting of the state store is put back."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _STORE)
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def run_available(spark: SparkSession, path: str, files_at_once: int | None = None, root: str | None = None) -> DataFrame:
    """The last state of each user once the stream has read all of a table."""
    root = root or f"{shared_dir(spark)}/lifecycles-{uuid.uuid4().hex[:12]}"
    run(lifecycles(stream_of(spark, path, files_at_once)), lambda batch, k: batch.write.mode("overwrite").parquet(f"{root}/out/batch={k}"), root)
    rows = spark.read.schema(SCHEMA + ", batch long").parquet(f"{root}/out")
    return rows.groupBy("user_id").agg(*(F.max_by(c, F.struct("n", "batch")).alias(c) for c in ("state", "since_us", *FIELDS)))
