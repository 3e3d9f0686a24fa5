"""Streams: resumable ingest of JSON lines, atomic batches, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailloom.functions.masking import mask
from mailloom.operators.records import RECORD
from mailloom.operators.sampling import whole_batches
from mailloom.sources import runs


def read_records(spark: SparkSession, path: str, schema=RECORD) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def masked_records(records: DataFrame) -> DataFrame:
    return records.withColumns({"subject": mask(F.col("subject")), "body": mask(F.col("body"))})


def mask_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema=RECORD) -> StreamingQuery:
    """Masks new files once and stops; begun again, it goes on after the last finished batch."""
    rows = masked_records(read_records(spark, source, schema))
    return rows.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def atomic_batches(rows: DataFrame, target: str, checkpoint: str, ok: str = "is_valid", batch: int | None = None, keys: tuple[str, ...] = ("source",), index: str = "seed_idx") -> StreamingQuery:
    """Writes only whole batches: with ``batch``, those of so many seeds of one model in which every row is valid, whatever micro-batches they share; else a micro-batch if all of its rows are valid.

    A micro-batch that is run again replaces what it wrote. A model's batch must arrive in
    one micro-batch, as files written batch by batch do: :func:`published_batches` waits for the rest.
    """

    def write(part: DataFrame, epoch: int) -> None:
        valid = F.coalesce(F.col(ok), F.lit(False))
        if batch is not None:
            part = whole_batches(part.withColumn(ok, valid), batch, list(keys), index, ok)
        elif part.filter(~valid).head(1):
            return
        part.drop(ok).write.mode("overwrite").json(f"{target}/batch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published_batches(rows: DataFrame, target: str, checkpoint: str, batch: int, keys: tuple[str, ...] = ("source",), index: str = "seed_idx", ok: str = "is_valid") -> StreamingQuery:
    """Publishes a batch, ``batch`` indices of one key, when its last row has come, whatever micro-batches they are spread over; see :mod:`mailloom.sources.runs`.

    Rows of open batches wait in a table of their own, written anew with each micro-batch, so that it holds open batches only. A batch
    with an invalid row is dropped once it is complete; of rows that repeat an index of an open batch one stays, an invalid one if there is one. Rows
    without a key or index are dropped. A micro-batch that is run again replaces its run, begun anywhere.
    """
    names = [f.name for f in rows.schema]

    def write(part: DataFrame, epoch: int) -> None:
        spark = part.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        at = lambda n: f"{target}/_open/{query}/{n}"
        schema = part.withColumn("__state", F.lit("open")).schema
        rows_ = part.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, index)))
        if epoch > 0:
            rows_ = spark.read.schema(schema).parquet(at(epoch - 1)).filter("__state = 'open'").select(*names).unionByName(rows_)
        valid = F.coalesce(F.col(ok), F.lit(False))
        # of a repeated index the invalid row, else any: the choice must not change a batch's fate
        mine = [*keys, index]
        one = rows_.groupBy(*mine).agg(F.min_by(F.struct(*names), F.struct(valid, F.xxhash64(*names))).alias("r")).select("r.*")
        own = one.withColumn("__b", F.floor(F.col(index) / batch))
        told = own.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.min(valid).alias("__good"))
        whole = F.when(F.col("__n") < batch, "open").when(F.col("__good"), "whole")
        marked = own.join(told, [*keys, "__b"]).withColumn("__state", whole).filter("__state is not null")
        marked.select(*names, "__state").write.mode("overwrite").parquet(at(epoch))
        found = spark.read.schema(schema).parquet(at(epoch)).filter("__state = 'whole'").select(*names).drop(ok)
        runs.write_run(found, target, query, f"{epoch:012d}")
        old = runs._path(spark, at(epoch - 2))
        runs._files(spark, old).delete(old, True)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predictions(raw: DataFrame, target: str, checkpoint: str, predict) -> StreamingQuery:
    """Raw messages of new files (path, content) to predictions, each file once; ``predict`` is a function of a frame."""

    def write(part: DataFrame, epoch: int) -> None:
        predict(part).write.mode("overwrite").json(f"{target}/batch={epoch}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; on a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
