"""Genre consensus over tags, with fallbacks by artist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, text


def tag_weight(source: Column) -> Column:
    rows = list(fixed.TAG_WEIGHTS.items())
    return reduce(lambda c, kv: c.when(source == kv[0], F.lit(kv[1])), rows[1:], F.when(source == rows[0][0], F.lit(rows[0][1]))).otherwise(F.lit(fixed.OTHER_TAG_WEIGHT))


def genre_consensus(tags: DataFrame, artists: DataFrame) -> DataFrame:
    """(entity_id, genre, subgenre, confidence) from tags (entity_id, seq, tag, weight, source) and artists (entity_id, artist).

    Entities are those of artists. Tags of one letter or of digits count nothing. A tag is spelled as it was first
    seen with a capital, else as first seen; ties of the score go to the tag seen first.
    """
    clean = text.one_space(F.lower("tag"))
    rows = tags.withColumn("clean", clean).where((F.length("clean") >= 2) & ~F.rlike("clean", F.lit("^[0-9]+$")))
    spelled = F.coalesce(F.min_by(F.trim("tag"), F.when(F.col("tag") != F.lower("tag"), F.col("seq"))), F.min_by(F.trim("tag"), "seq"))
    scores = rows.groupBy("entity_id", "clean").agg(F.round(F.sum(F.col("weight") * tag_weight(F.col("source"))), 6).alias("score"), F.min("seq").alias("first"), spelled.alias("spelled"))
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "first"))
    top = scores.withColumn("n", n).where("n <= 2")
    title = text.title_case(F.col("spelled"))
    best = top.groupBy("entity_id").agg(F.max(F.when(F.col("n") == 1, title)).alias("one"), F.max(F.when(F.col("n") == 2, title)).alias("two"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"))
    main, sub = text.fallback_genres(F.col("artist"))
    out = artists.select("entity_id", main.alias("main"), sub.alias("sub")).join(best, "entity_id", "left")
    return _agreed(out).select("entity_id", "genre", "subgenre", "confidence")


def _agreed(out: DataFrame) -> DataFrame:
    """Rows with genre, subgenre and confidence from their two best tags (one, two), the best one's score and the artist's fallbacks (main, sub)."""
    out = out.withColumn("genre", F.when(F.col("one").isNull() | (F.lower("one") == "unclassified"), F.col("main")).otherwise(F.col("one")))
    second = F.when(F.col("two").isNotNull() & (F.lower("two") != "unclassified") & (F.lower("two") != F.lower("genre")), F.col("two")).otherwise(F.col("sub"))
    out = out.withColumn("second", F.when(F.col("one").isNull(), F.col("sub")).otherwise(second))
    other = F.when(F.lower("sub") != F.lower("genre"), F.col("sub")).otherwise("Alternative Rock")
    sub_out = F.when(F.col("one").isNotNull() & (F.lower("second") == F.lower("genre")), other).otherwise(F.col("second"))
    confidence = F.when(F.col("one").isNull(), 0.50).otherwise(F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.40), 0.40 + F.col("score") * 0.10)), 2))
    return out.withColumn("subgenre", sub_out).withColumn("confidence", confidence)


_SEEN = "struct<seq:string,tag:string>"


def row_consensus(rows: DataFrame) -> DataFrame:
    """Rows (listed, artist, ...) with genre, subgenre and confidence: the consensus of an entity whose tags all lie in its row.

    listed: array of (seq, tag, weight, source), judged as genre_consensus judges the tags of an entity.
    """
    tags = F.transform("listed", lambda x: F.struct(text.one_space(F.lower(x["tag"])).alias("clean"), x["seq"].alias("seq"), F.trim(x["tag"]).alias("tag"), (x["tag"] != F.lower(x["tag"])).alias("capital"), (x["weight"] * tag_weight(x["source"])).alias("w")))
    rows = rows.withColumn("__tags", F.filter(tags, lambda x: (F.length(x["clean"]) >= 2) & ~F.rlike(x["clean"], F.lit("^[0-9]+$"))))

    def scored(clean: Column) -> Column:
        # One pass over the tags: their score, the first one, and the first with a capital.
        start = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(_SEEN).alias("first"), F.lit(None).cast(_SEEN).alias("capital"))
        seen = lambda x: F.struct(x["seq"].alias("seq"), x["tag"].alias("tag"))
        step = lambda a, x: F.when(x["clean"] == clean, F.struct((a["score"] + x["w"]).alias("score"), F.least(a["first"], seen(x)).alias("first"), F.when(x["capital"], F.least(a["capital"], seen(x))).otherwise(a["capital"]).alias("capital"))).otherwise(a)
        return F.aggregate("__tags", start, step, lambda a: F.struct((-F.round(a["score"], 6)).alias("minus"), a["first"]["seq"].alias("first"), F.coalesce(a["capital"]["tag"], a["first"]["tag"]).alias("spelled")))

    rows = rows.withColumn("__best", F.array_sort(F.transform(F.array_distinct(F.transform("__tags", lambda x: x["clean"])), scored)))
    best = lambda n: F.get("__best", n)
    title = lambda n: F.when(best(n).isNotNull(), text.title_case(best(n)["spelled"]))
    main, sub = text.fallback_genres(F.col("artist"))
    rows = rows.withColumns({"one": title(0), "two": title(1), "score": -best(0)["minus"], "main": main, "sub": sub})
    return _agreed(rows).drop("__tags", "__best", "one", "two", "score", "main", "sub", "second")
