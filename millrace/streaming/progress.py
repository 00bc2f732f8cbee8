"""Progress of running jobs on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def source(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table of an input folder as a stream, whether it is a file or a folder of files."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")


def counts(stream: DataFrame) -> DataFrame:
    """Running figures by type of event."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))


def last_state(stream: DataFrame) -> DataFrame:
    """The last event of each worker."""
    last = F.struct("ts", "event_id")
    return stream.groupBy(F.col("user_id").alias("worker_id")).agg(F.count("*").alias("items"), F.max_by("event_type", last).alias("status"), F.max(last)["event_id"].alias("last_event"))


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(result: DataFrame, folder: str, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that its source has now, batch by batch, and return the sink's rows.

    In update mode keys name a row; of a key's rows the last batch's counts. The same folder again
    resumes after the last batch that was committed: a batch that was tried twice counts once.
    """
    spark, schema = result.sparkSession, result.schema
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(f"{folder}/rows")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    q = result.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if mode == "update" and keys:
        row = F.struct(*(F.col(c) for c in result.columns))
        return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max_by(row, "batch").alias("r")).select("r.*")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), rows["batch"] == last["last"], "left_semi").select(result.columns)  # one row


#: What an event makes of a node that isn't done.
STEPS = {"error": "error", "purchase": "completed"}


def fold(stream: DataFrame) -> DataFrame:
    """Status of each node over its events: processing, then error or completed, which stay; and how many events it saw."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames, state: GroupState):
        status, seen = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            seen += 1
            if status not in ("error", "completed"):
                status = STEPS.get(kind, "processing")
        state.update((status, seen))
        yield pd.DataFrame({"node": [key[0]], "status": [status], "seen": [seen]})

    keyed = stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "node long, status string, seen long", "status string, seen long", "update", GroupStateTimeout.NoTimeout)


def heartbeats(stream: DataFrame, idle: str = "1 second") -> DataFrame:
    """An event for each job that was silent for so long (by processing time), and one for each batch that it spoke in."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    number, unit = idle.split()
    millis = int(number) * {"s": 1000, "m": 60_000}[unit[0]]

    def beat(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            seen = state.get[0]
            kind = "heartbeat"
        else:
            seen = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
            kind = "events"
        state.update((seen,))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame({"job": [key[0]], "type": [kind], "seen": [seen]})

    keyed = stream.select(F.col("event_type").alias("job")).groupBy("job")
    return keyed.applyInPandasWithState(beat, "job string, type string, seen long", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: The types of events that a progress stream has.
TYPES = ("worker_update", "item_completed", "tree_init", "heartbeat", "phase_start", "crawl_progress", "phase_complete", "batch_completed", "batch_transition")
#: What the kinds of the events table stand for.
NAMED = {"view": "worker_update", "click": "item_completed", "signup": "phase_start", "purchase": "batch_completed"}


def typed(stream: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Events with their type; one of no known kind is an error."""
    names = names or NAMED
    if not set(names.values()) <= set(TYPES):
        raise ValueError("not a type of a progress stream")
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return stream.withColumn("type", F.coalesce(F.try_element_at(pairs, F.col("event_type")), F.lit("error")))


def snapshot(stream: DataFrame, made) -> DataFrame:
    """A job's figures over its events: how far it is, items completed, pairs made (a column, of completed items), and its last event."""
    done = F.col("event_type") == "click"
    return stream.groupBy(F.col("user_id").alias("job")).agg(
        F.max("event_id").alias("current"), F.count_if(done).alias("topics_completed"),
        F.coalesce(F.sum(F.when(done, made)), F.lit(0)).alias("qa_generated"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"),
    )


def stitched(batches: DataFrame) -> DataFrame:
    """Events of a run over several batches (batch, n): each batch's end, a transition before the next, and the run's end."""
    total = batches.agg(F.max("batch").alias("total"))
    own = batches.crossJoin(F.broadcast(total))  # one row
    kinds = F.array(
        F.struct(F.lit("batch_completed").alias("type"), F.col("n").alias("n")),
        F.when(F.col("batch") < F.col("total"), F.struct(F.lit("batch_transition").alias("type"), F.lit(None).cast("long").alias("n"))),
        F.when(F.col("batch") == F.col("total"), F.struct(F.lit("completed").alias("type"), F.lit(None).cast("long").alias("n"))),
    )
    return own.select("batch", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("batch", "k.type", "k.n")


def cancelled(spark: SparkSession, query, folder: str, save: bool) -> DataFrame | None:
    """Stop a stream that drained() would run: the rows of the batches that it has committed, or nothing, and its folder goes."""
    query.stop()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not save:
        fs.delete(path, True)
        return None
    rows = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows") if fs.exists(rows) else None
