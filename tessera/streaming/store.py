"""Files taken in batch by batch, each against everything that was taken in before and against those before it in its batch.

Below the store's folder lie ``files`` (what was accepted, by batch), ``duplicates`` (what wasn't, and why, by batch) and ``keys`` (the keys
of what was accepted, by bucket of a key's hash and by batch). A batch reads the buckets that its own keys fall in, and
of those what earlier batches wrote; it replaces what an earlier attempt at itself left. So a batch that is run again gives
the same store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedup
from tessera.operators.graph import cut, stored

BUCKETS = 64
#: Keys of a file in the order in which they name a duplicate, and the reach of the fingerprint's in seconds.
KEYS = ["md5_file", "audio_stream_hash", "heard", "titled"]
NEAR, WITHIN = {"heard": "duration"}, 2.0
_HELD = "k string, v string, d double, bucket int, batch long"


def keyed(files: DataFrame) -> DataFrame:
    """Files (path, md5_file, audio_stream_hash, duration, fingerprint, title, artist) with their third and fourth key; a blank one is none."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    titled = F.concat(F.lower(filled(F.col("title"))), F.lit("\n"), F.nullif(text.artist_key(filled(F.col("artist"))), F.lit("")))
    return files.withColumn("heard", F.when(F.col("duration") > 0, filled(F.col("fingerprint")))).withColumn("titled", titled)


def _bucketed(found: DataFrame) -> DataFrame:
    return found.withColumn("bucket", F.pmod(F.xxhash64("k", "v"), F.lit(BUCKETS)).cast("int"))


def held_keys(spark: SparkSession, store: str, buckets: list[int], batch: int) -> DataFrame:
    """(k, v, d, bucket, batch) of these buckets as earlier batches left them."""
    try:
        keys = spark.read.schema(_HELD).parquet(f"{store}/keys")
    except AnalysisException as missing:  # the first batch finds no store
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _HELD)
    return keys.where(F.col("bucket").isin(buckets) & (F.col("batch") < batch))


def add_batch(rows: DataFrame, batch: int, store: str, order: str = "path") -> None:
    """Take in the files of one batch, in the order of a column that is different for each: see keyed() for the columns."""
    spark = rows.sparkSession
    files = stored(keyed(rows))
    mine = files.select(*dict.fromkeys([order, "path", *KEYS, "duration"]))
    buckets = sorted(r.bucket for r in _bucketed(dedup.entries(mine, order, KEYS, NEAR)).select("bucket").distinct().collect())  # of BUCKETS
    held = cut(held_keys(spark, store, buckets, batch).select("k", "v", "d").withColumn("taken", F.lit(None).cast(dict(mine.dtypes)[order])))
    left = mine if held.isEmpty() else stored(dedup.ranked(mine, order, KEYS, NEAR, WITHIN, held).where("rank IS NULL").drop("rank"))
    accepted = cut(dedup.first_come(left, order, KEYS, NEAR, WITHIN).select(order))
    kept = files.join(F.broadcast(accepted) if accepted.count() <= dedup.FEW else accepted, order, "left_semi")
    taken = cut(dedup.entries(kept, order, KEYS, NEAR).withColumnRenamed(order, "taken"))
    named = dedup.ranked(mine, order, KEYS, NEAR, WITHIN, held.unionByName(taken.select("k", "v", "d", "taken"))).where("rank IS NOT NULL")
    label = F.get(F.array(*map(F.lit, dedup.LABELS)), F.col("rank"))
    write = lambda frame, name, *by: frame.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by, "batch").parquet(f"{store}/{name}")
    write(named.select(*dict.fromkeys([order, "path"]), label.alias("label")), "duplicates")
    write(kept.drop("heard", "titled"), "files")
    write(_bucketed(taken.select("k", "v", "d")).repartition("bucket"), "keys", "bucket")


def ingest(stream: DataFrame, store: str, checkpoint: str, order: str = "path", available_now: bool = True):
    """Take in a stream's files batch by batch."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, store, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accepted_files(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/files")
