"""Facts that siblings of an album take over from a donor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sibling_facts(donors: DataFrame, siblings: DataFrame, locks: DataFrame) -> DataFrame:
    """(entity_id, field_name, value, confidence) derived from donors of the same album.

    donors: (album_id, donor, artist, album, release_date, original_release_date, genre, subgenre, compilation);
    those without a classified genre give nothing. siblings: (album_id, entity_id). Fields locked as MANUAL or
    PROTECTED are left out, and the artist on a compilation.
    """
    fact = lambda c, confidence, where=F.lit(True): F.when(where & (F.coalesce(F.col(c), F.lit("")) != ""), F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value"), F.lit(confidence).alias("confidence")))
    facts = F.array(
        fact("album", 0.92),
        fact("release_date", 0.92),
        fact("original_release_date", 0.99),
        fact("genre", 0.85),
        fact("subgenre", 0.85, F.col("subgenre") != "Unclassified"),
        fact("artist", 0.92, ~F.col("compilation")),
    )
    giving = donors.where("genre IS NOT NULL AND genre <> 'Unclassified'").select("album_id", "donor", F.explode(F.array_compact(facts)).alias("f")).select("album_id", "donor", "f.*")
    out = siblings.join(giving, "album_id").where("entity_id <> donor")
    held = locks.where("lock_state IN ('MANUAL', 'PROTECTED')").select("entity_id", "field_name")
    return out.join(held, ["entity_id", "field_name"], "left_anti").select("entity_id", "field_name", "value", "confidence")


def buffer_facts(facts: DataFrame, known: DataFrame) -> DataFrame:
    """New facts: no blanks or placeholders, one for each (entity, field, source, folded value), weights within 0 and 1."""
    value = F.trim("value")
    rows = facts.where((F.coalesce(value, F.lit("")) != "") & ~F.upper(value).isin("NONE", "NULL", "UNKNOWN"))
    rows = rows.withColumn("folded", F.lower(value))
    rows = rows.groupBy("entity_id", "field_name", "source_id", "folded").agg(F.min_by(F.struct(value.alias("value"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence")), "id").alias("x"))
    there = known.select("entity_id", "field_name", "source_id", F.lower(F.trim("value")).alias("folded"))
    return rows.join(there, ["entity_id", "field_name", "source_id", "folded"], "left_anti").select("entity_id", "field_name", "source_id", "x.value", "x.confidence")
