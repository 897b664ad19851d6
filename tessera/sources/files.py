"""Readers and writers of the catalog's file formats, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in one of the formats; text formats need a schema, so nothing is read to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    if kind in ("json", "csv") and not schema:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.format(kind).load(path)


def read_database(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, properties: dict[str, str]) -> DataFrame:
    """A table of a database over JDBC, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)


def write_export(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header in one global order, a file for each range of it."""
    rows.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Tab-separated lines."""
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A folder for each value of split."""
    writer = rows.write.mode("overwrite").partitionBy("split")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def check_shares(train: int, validation: int, test: int) -> None:
    if train + validation + test != 100 or min(train, validation, test) < 0:
        raise ValueError("the shares of a split sum to 100")


def fingerprint(output: str) -> dict[str, str]:
    """KEY=VALUE lines of a fingerprint program; a fingerprint of less than ten characters is none."""
    found = dict(line.split("=", 1) for line in output.splitlines() if "=" in line)
    if len(found.get("FINGERPRINT", "")) < 10:
        found.pop("FINGERPRINT", None)
    return found


def parsed_fingerprints(rows: DataFrame) -> DataFrame:
    """The same over a column ``output``."""
    lines = F.filter(F.split("output", r"\r?\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_extract(x, "(?s)=(.*)", 1))))
    return rows.withColumn("pairs", pairs).withColumn("duration", F.element_at("pairs", "DURATION").try_cast("double")).withColumn("fingerprint", F.when(F.length(F.element_at("pairs", "FINGERPRINT")) >= 10, F.element_at("pairs", "FINGERPRINT"))).drop("pairs")


def markdown_report(figures: DataFrame, title: str, most: int = 1000) -> str:
    """A report of figures (metric, n), ordered; more than ``most`` are an error, as a report is to be read."""
    rows = figures.orderBy("metric").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} figures at most")
    return "\n".join([f"# {title}", "", "| metric | n |", "|---|---|", *[f"| {r.metric} | {r.n} |" for r in rows], ""])


def run_report(runs: DataFrame, decisions: DataFrame, run_id: str, sample: int = 30) -> str:
    """A report of one run and of its first decisions, of which it tells how many there are."""
    run = runs.where(F.col("run_id") == run_id).first()
    rows = decisions.where(F.col("run_id") == run_id)
    shown = rows.orderBy("id").limit(sample).collect()
    lines = [f"# Run {run_id}", "", f"* started: {run.started_at if run else 'unknown'}", f"* finished: {(run.finished_at if run else None) or 'not yet'}", f"* decisions: {rows.count()}, the first {len(shown)} below", ""]
    return "\n".join([*lines, *[f"* `{r.field_name}` of {r.entity_id}: '{r.selected_value}' (was '{r.old_value}')" for r in shown], ""])


def library_report(recordings: DataFrame, validation: DataFrame, assets: DataFrame, overview: DataFrame, most: int = 1000) -> str:
    """A summary: tracks, mean quality, formats with their shares of the tracks (more than ``most`` are an error), the five largest genres."""
    total = recordings.count()
    mean = validation.agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("q")).first().q
    count = lambda rows, key: rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("k"))
    part = lambda r, other: f"* {r.k or other}: {r.n} ({100 * r.n / total if total else 0:.1f} %)"
    formats = count(assets, F.upper("format")).limit(most + 1).collect()
    if len(formats) > most:
        raise ValueError(f"a report holds {most} formats at most")
    formats = [part(r, "UNKNOWN") for r in formats]
    genres = [part(r, "Unclassified") for r in count(overview, F.col("primary_genre")).limit(5).collect()]
    return "\n".join(["# Library", "", f"* tracks: {total}", f"* mean quality: {100 * mean:.1f} %", "", "## Formats", "", *formats, "", "## Genres", "", *genres, ""])


def table_sizes(spark: SparkSession) -> DataFrame:
    """Names of the session's tables and views."""
    return spark.createDataFrame([(x.name, x.isTemporary) for x in spark.catalog.listTables()], "name string, temporary boolean")


def drop_views(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.catalog.dropTempView(name)
