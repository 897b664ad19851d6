"""The ledger of runs: a row when one starts, stamped when it ends; progress of a run as figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mutate


def start_run(runs: DataFrame, run_id: str, version: str, config: str, at: Column) -> DataFrame:
    """The ledger with a row for a run that starts; a run that is there already is kept as it is."""
    new = runs.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(version).alias("parser_version"), F.sha2(F.lit(config).cast("binary"), 256).alias("config_hash"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return mutate.insert_ignore(runs.select(*new.columns), new, ["run_id"], [F.col("started_at")])


def finish_run(runs: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The ledger with the end of a run that has none."""
    return mutate.update_where(runs, (F.col("run_id") == run_id) & F.col("finished_at").isNull(), {"finished_at": at})


def observed(rows: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds figures of them once they have been written: counts of the same scan, no second one."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[column.alias(key) for key, column in figures.items()]), seen


def batch_figures(spark: SparkSession, seen: list[Observation], seconds: float | None = None) -> DataFrame:
    """(batch, metric, n) of observed batches that have been written, and rows a second where the seconds are known."""
    data = [(o._name, key, float(n) if n is not None else None) for o in seen for key, n in o.get.items()]
    if seconds:
        data += [(name, "rows_per_second", n / seconds) for name, key, n in data if key == "rows"]
    return spark.createDataFrame(data, "batch string, metric string, n double")


def progress(rows: DataFrame) -> DataFrame:
    """(run_id, done, tps, eta, finish, stage_pct, total_pct) from (run_id, done, total, seconds): rate, seconds and text of what is left, shares.

    The first stage is half of a run.
    """
    tps = F.col("done") / F.greatest(F.lit(0.001), F.col("seconds"))
    eta = F.when(tps > 0, (F.col("total") - F.col("done")) / tps).otherwise(0.0)
    stage = F.floor(F.col("done") / F.col("total") * 100).cast("int")
    text = F.when(eta > 0, F.concat(F.floor(eta).cast("string"), F.lit("s left"))).otherwise("Finishing...")
    return rows.select("run_id", "done", F.round(tps, 1).alias("tps"), F.round(eta, 3).alias("eta"), text.alias("finish"), stage.alias("stage_pct"), F.floor(stage / 2).cast("int").alias("total_pct"))
