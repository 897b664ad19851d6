"""Scoring and admission of candidates against the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed, text


def weights(strategy: str = "Balanced Curator", custom: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of a strategy, or custom ones, that sum to one; an unknown strategy is the first."""
    raw = custom or fixed.STRATEGIES.get(strategy, fixed.STRATEGIES["Balanced Curator"])
    total = sum(raw.values()) or 1.0
    return {name: raw.get(name, default) / total if name in raw else default for name, default in fixed.STRATEGIES["Balanced Curator"].items()}


def score_candidates(candidates: DataFrame, library: DataFrame, scored_before: DataFrame, confidence=None, strategy: str = "Balanced Curator", custom: dict[str, float] | None = None) -> DataFrame:
    """(candidate_id, v_rel, v_graph, v_def, p_sat, fatigue, ccs, margin, explanation) for each candidate.

    library: rows of the overview, from which genres, subgenres and artists are counted once each. scored_before:
    candidates that had a score before this run. confidence: a column of the candidates' identifier confidence.
    """
    # The library is joined and shuffled once; the three counts come from its groups.
    groups = library.groupBy("primary_genre", "primary_subgenre", F.lower("artist_name").alias("artist")).agg(F.count("*").alias("n"))
    count = lambda c, name: groups.groupBy(F.col(c).alias(f"__{name}")).agg(F.sum("n").alias(name))
    genre, sub, artist = count("primary_genre", "n_genre"), count("primary_subgenre", "n_sub"), count("artist", "n_artist")
    c = candidates.join(genre, F.col("primary_genre") == F.col("__n_genre"), "left").join(sub, F.col("primary_subgenre") == F.col("__n_sub"), "left")
    c = c.join(artist, F.lower(F.trim("artist_name")) == F.col("__n_artist"), "left").na.fill(0, ["n_genre", "n_sub", "n_artist"])
    c = c.join(scored_before.select("candidate_id", F.lit(True).alias("seen")).distinct(), "candidate_id", "left")
    no_genre = (F.coalesce("primary_genre", F.lit("")) == "") | (F.col("primary_genre") == "Unclassified")
    no_sub = (F.coalesce("primary_subgenre", F.lit("")) == "") | (F.col("primary_subgenre") == "Unclassified")
    sub_count = F.when(no_sub, 0).otherwise(F.col("n_sub"))
    v_rel = F.when(no_genre, 0.40).when(F.col("n_genre") == 0, 0.30).otherwise(F.round(F.least(F.lit(1.0), 0.40 + F.col("n_genre") / 100 * 0.40 + sub_count / 20 * 0.20), 2))
    v_graph = confidence if confidence is not None else F.round(F.greatest(F.lit(0.20), 0.25 * F.when(F.coalesce(F.trim("release_group_mbid"), F.lit("")) != "", 1).otherwise(0)), 2)
    unknown = (F.coalesce("artist_name", F.lit("")) == "") | (F.lower("artist_name") == "unknown artist")
    c = c.select(
        "candidate_id",
        v_rel.alias("v_rel"),
        v_graph.alias("v_graph"),
        F.when(no_sub, 0.50).otherwise(text.deficit(F.col("n_sub"))).alias("v_def"),
        F.when(unknown, 1.00).otherwise(text.saturation(F.col("n_artist"))).alias("p_sat"),
        F.when(F.col("seen"), fixed.FATIGUE).otherwise(1.00).alias("fatigue"),
    )
    w = weights(strategy, custom)
    raw = (w["rel"] * F.col("v_rel") + w["coll"] * fixed.COLLECTOR_SCORE + w["graph"] * F.col("v_graph") + w["def"] * F.col("v_def")) * F.col("p_sat") * F.col("fatigue")
    # Rounded twice: once so that every engine sees one number, then to the score's three places.
    ccs = F.round(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 9), 3)
    margin = F.round(F.round(0.04 + (1.0 - F.col("v_graph")) * 0.10, 9), 3)
    scores = F.struct("v_rel", F.lit(fixed.COLLECTOR_SCORE).alias("v_coll"), "v_graph", "v_def")
    explanation = F.to_json(F.struct(F.lit(strategy).alias("active_strategy"), scores.alias("scores"), F.struct("p_sat", "fatigue").alias("penalties"), margin.alias("uncertainty_margin")))
    return c.withColumn("ccs", ccs).withColumn("margin", margin).withColumn("explanation", explanation)


def admit(found: DataFrame, known: DataFrame, owned: DataFrame, affinity: DataFrame, target: str | None = None) -> DataFrame:
    """(candidate_id, title, artist_name, genre, ccs) of new candidates (title, artist_name, genre, mbid).

    Dropped: titles with a blocked word, genres and titles without the target, owned ones (keys kt, ka), known ids.
    """
    title = F.lower("title")
    rows = found.where(~F.exists(F.array(*map(F.lit, fixed.TITLE_BLOCKLIST)), lambda w: F.contains(title, w)))
    if target:
        rows = rows.where(F.contains(F.lower("genre"), F.lit(target)) | F.contains(title, F.lit(target)))
    rows = rows.withColumn("kt", text.alnum_key(F.col("title"))).withColumn("ka", text.alnum_key(F.col("artist_name"))).join(owned.hint("merge"), ["kt", "ka"], "left_anti")
    rows = rows.withColumn("candidate_id", text.candidate_id(F.col("title"), F.col("artist_name"))).dropDuplicates(["candidate_id"]).join(known.select("candidate_id").hint("merge"), "candidate_id", "left_anti")
    share = affinity.select(F.col("genre").alias("g"), "score")
    return rows.join(share, F.lower("genre") == F.col("g"), "left").select("candidate_id", "title", "artist_name", "genre", F.coalesce("score", F.lit(0.8)).alias("ccs"))
