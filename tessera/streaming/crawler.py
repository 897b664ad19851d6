"""The crawler's loop: one step at a time over versions of the frontier, throttled, and safe to be stopped anywhere.

A stream's clock gives the steps. Step n reads version n of the frontier, writes the candidates that it admits, and last version
n + 1 of the frontier. A version counts once Spark has marked it as written whole, so a step that was cut short is done again
from the same version and writes over what it had left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between two steps, and versions of the frontier that stay.
THROTTLE, KEPT = 12.0, 3

Step = Callable[[DataFrame, DataFrame | None], dict[str, DataFrame]]


class Frontier:
    """Versions of a frontier, and the candidates found so far, below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/frontier/version={version}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, version: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version), "_SUCCESS")
        return self._files(mark).exists(mark)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/frontier/version={version}")

    def write(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/frontier/version={version}")

    def drop(self, version: int) -> None:
        path = self._path(version)
        self._files(path).delete(path, True)

    def candidates(self, version: int) -> DataFrame | None:
        """Those admitted up to a version; None before the first step that admitted any."""
        try:
            return self.spark.read.parquet(f"{self.folder}/candidates").where(F.col("version") <= version)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def take(self, number: int, step: Step, kept: int = KEPT) -> None:
        """Step ``number``, unless it has been taken."""
        if self.has(number + 1):
            return
        if not self.has(number):
            raise ValueError(f"version {number} of the frontier isn't there: folder and checkpoint don't belong together")
        made = step(self.read(number), self.candidates(number))
        made["candidates"].write.mode("overwrite").parquet(f"{self.folder}/candidates/version={number + 1}")
        self.write(number + 1, made["frontier"])
        if number + 1 >= kept:
            self.drop(number + 1 - kept)


def crawl(start: DataFrame, step: Step, folder: str, checkpoint: str, throttle: float = THROTTLE, kept: int = KEPT):
    """A running query that takes a step (frontier, candidates or None) -> {"frontier", "candidates"} every ``throttle`` seconds.

    start: the first frontier; a folder that has one goes on with its own. See operators.crawl for the steps themselves.
    """
    spark = start.sparkSession
    frontier = Frontier(spark, folder)
    if not any(frontier.has(v) for v in _versions(spark, folder)):
        frontier.write(0, start)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _, number: frontier.take(number, step, kept))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(1000 * throttle)} milliseconds").start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/frontier")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path)) if files.exists(path) else []
