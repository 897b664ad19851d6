"""Queries over stateful behaviour: breakers, buckets, feedback, windowed counts, streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import limits
from tessera.plans.registry import catalog_query as q
from tessera.sources.fixtures import Catalog
from tessera.streaming import ingest as streams

THRESHOLD, RECOVERY, FILL, CAPACITY = 2, 90_000.0, 0.0001, 2.0
_SEQ = "seq AS (SELECT user_id, epoch(ts) AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS n FROM events)"


def calls(t: Catalog) -> DataFrame:
    return t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), (F.col("event_type") != "error").alias("ok"))


@q(
    "ss04_breaker",
    f"""WITH RECURSIVE {_SEQ}, fold AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'CLOSED' AS state, 0 AS failures, CAST(0 AS DOUBLE) AS last, 0 AS rejected FROM (SELECT DISTINCT user_id FROM events) u
    UNION ALL SELECT f.user_id, s.n, CASE WHEN f.state = 'OPEN' AND s.at - f.last <= {RECOVERY} THEN 'OPEN' WHEN s.ok THEN 'CLOSED' WHEN f.state = 'OPEN' OR f.failures + 1 >= {THRESHOLD} THEN 'OPEN' ELSE 'CLOSED' END,
      CASE WHEN f.state = 'OPEN' AND s.at - f.last <= {RECOVERY} THEN f.failures WHEN s.ok THEN 0 ELSE f.failures + 1 END, CASE WHEN (f.state = 'OPEN' AND s.at - f.last <= {RECOVERY}) OR s.ok THEN f.last ELSE s.at END,
      CASE WHEN f.state = 'OPEN' AND s.at - f.last <= {RECOVERY} THEN f.rejected + 1 ELSE f.rejected END FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.n = f.n + 1)
    SELECT user_id, arg_max(state, n) AS state, arg_max(failures, n) AS failures, arg_max(rejected, n) AS rejected FROM fold GROUP BY user_id""",
)
def breaker(t: Catalog) -> DataFrame:
    return limits.breaker_states(calls(t), "user_id", "at", "event_id", THRESHOLD, RECOVERY)


@q(
    "ss05_token_bucket",
    f"""WITH RECURSIVE {_SEQ}, fold AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST({CAPACITY} AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS at, CAST(0 AS DOUBLE) AS waited, 0 AS delayed FROM (SELECT DISTINCT user_id FROM events) u
    UNION ALL SELECT user_id, n, CASE WHEN have < 1 THEN 0 ELSE have - 1 END, now + wait, waited + wait + now - called, delayed + CASE WHEN have < 1 THEN 1 ELSE 0 END FROM (SELECT *, CASE WHEN have < 1 THEN (1.0 - have) / {FILL}::DOUBLE ELSE 0 END AS wait FROM (SELECT f.user_id, s.n, s.at AS called, greatest(s.at, f.at) AS now, least({CAPACITY}::DOUBLE, f.tokens + greatest(0.0::DOUBLE, greatest(s.at, f.at) - f.at) * {FILL}::DOUBLE) AS have, f.waited, f.delayed FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.n = f.n + 1) a) b)
    SELECT user_id, arg_max(delayed, n) AS delayed, round(arg_max(waited, n), 3) AS waited FROM fold GROUP BY user_id""",
)
def bucket(t: Catalog) -> DataFrame:
    return limits.bucket_waits(calls(t), "user_id", "at", "event_id", FILL, CAPACITY)


_FEEDBACK = "SELECT s_name AS entity_name, CASE s_suppkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'snooze' ELSE 'ignore' END AS action FROM supplier WHERE s_suppkey % 2 = 0"


@q("ss08_feedback_batch", f"SELECT f.seed_id, round(CASE WHEN b.action = 'accept' THEN priority + 0.25 WHEN b.action = 'snooze' THEN greatest(0.1, priority - 0.20) WHEN b.action = 'ignore' THEN greatest(0.1, priority - 0.40) ELSE priority END, 6)::DOUBLE AS priority FROM sys_crawl_frontier f LEFT JOIN ({_FEEDBACK}) b ON f.entity_name = b.entity_name")
def feedback(t: Catalog) -> DataFrame:
    action = F.when(F.col("s_suppkey") % 3 == 0, "accept").when(F.col("s_suppkey") % 3 == 1, "snooze").otherwise("ignore")
    rows = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("entity_name"), action.alias("action"))
    return streams.apply_feedback(t.sys_crawl_frontier, rows).select("seed_id", F.round("priority", 6).alias("priority"))


q("ss09_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")(lambda t: streams.event_counts(t.events))


@q("ss02_ingest_dedup", "SELECT path, md5_file, size FROM (SELECT asset_id AS path, md5_file, file_size AS size FROM core_assets WHERE channels = 1) k UNION ALL SELECT min(asset_id), md5_file, arg_min(file_size, asset_id) FROM core_assets WHERE md5_file NOT IN (SELECT md5_file FROM core_assets WHERE channels = 1) GROUP BY md5_file")
def ingest_dedup(t: Catalog) -> DataFrame:
    """One batch of the watched folder's stream: all assets, against a store that has those of one channel."""
    files = t.core_assets.select(F.col("asset_id").alias("path"), "md5_file", F.col("file_size").alias("size"))
    return streams.ingest_batch(files, t.core_assets.where("channels = 1").select(F.col("asset_id").alias("path"), "md5_file", F.col("file_size").alias("size")))
