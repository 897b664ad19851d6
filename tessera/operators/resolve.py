"""Evidence consensus: many facts about a field of an entity to one value, explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed, text

#: Fields whose winner is spelled as normalised; all others keep the first spelling seen.
SPELLED_NORMAL = ["musicbrainz_recording_id", "musicbrainz_release_id", "musicbrainz_artist_id", "genre", "subgenre"]


def _pick(key: Column, table: dict, default) -> Column:
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = table.items()
    return reduce(lambda c, kv: c.when(key == kv[0], value(kv[1])), rest, F.when(key == first[0], value(first[1]))).otherwise(value(default))


def family_of(source: Column) -> Column:
    return _pick(source, fixed.SOURCE_FAMILIES, fixed.OTHER_FAMILY)


def prior_of(field: Column, family: Column) -> Column:
    tables = {name: _pick(family, table, fixed.MISSING_PRIOR) for name, table in fixed.FIELD_PRIORS.items()}
    return _pick(field, tables, _pick(family, fixed.DEFAULT_PRIORS, fixed.MISSING_PRIOR))


def usable(evidence: DataFrame) -> DataFrame:
    """Facts with a value that isn't blank or a placeholder, with family and normalised value."""
    raw = F.trim("value")
    kept = evidence.where((F.coalesce(raw, F.lit("")) != "") & ~F.upper(raw).isin("NONE", "NULL"))
    kept = kept.withColumn("raw", raw).withColumn("norm", text.normalise(F.col("field_name"), raw))
    return kept.where("norm <> ''").withColumn("family", family_of(F.col("source_id")))


def candidates(evidence: DataFrame, references: DataFrame | None = None, strict_subgenre: bool = False) -> DataFrame:
    """(entity_id, field_name, norm, value, trust, families, first_id) for each distinct value.

    Trust: over families the mean of confidence times positional weight, times the family's prior, summed, less a
    penalty; at least 0.01. references (entity_id, reference) are artists that an artist's value is held against.
    strict_subgenre penalises generic subgenres.
    """
    facts = usable(evidence)
    by_family = facts.groupBy("entity_id", "field_name", "norm", "family").agg(F.avg(F.col("confidence") * F.col("positional_weight")).alias("mean"), F.min(F.struct("id", "raw")).alias("first"))
    by_family = by_family.withColumn("score", F.col("mean") * prior_of(F.col("field_name"), F.col("family")))
    out = by_family.groupBy("entity_id", "field_name", "norm").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("family")).alias("families"), F.min("first").alias("first"))
    bad = F.lit(False)
    if references is not None:
        from tessera.functions.exact import similarity

        out = out.join(references, "entity_id", "left")
        unlike = similarity("norm", "reference") < 0.40
        bad = (F.col("field_name") == "artist") & F.col("reference").isNotNull() & unlike & ~F.array_contains("families", "USER_OVERRIDE")
    if strict_subgenre:
        bad = bad | ((F.col("field_name") == "subgenre") & F.lower("norm").isin(*fixed.GENERIC_SUBGENRES))
    trust = F.greatest(F.lit(fixed.LEAST_TRUST), F.round(F.col("score") - F.when(bad, fixed.PENALTY).otherwise(0.0), 9))
    value = F.when(F.col("field_name").isin(SPELLED_NORMAL), F.col("norm")).otherwise(F.col("first.raw"))
    return out.select("entity_id", "field_name", "norm", value.alias("value"), trust.alias("trust"), "families", F.col("first.id").alias("first_id"))


def resolve(evidence: DataFrame, locks: DataFrame, current: DataFrame, targets: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """One decision for each (entity_id, field_name) of the evidence, and of targets where given.

    (entity_id, field_name, old_value, selected_value, trust, reason, rejected). A MANUAL lock keeps the current
    value, PROTECTED does unless a user's fact is there; so do missing or unusable facts. Winners: most trust, then
    most families, then the fact seen first.
    """
    key = ["entity_id", "field_name"]
    seen = evidence.groupBy(*key).agg(F.max(F.col("source_id") == "SRC_USER").alias("by_user"))
    wanted = seen if targets is None else targets.select(*key).distinct().join(seen, key, "full")
    found = candidates(evidence, references)
    # Best first; first_id is unique, so nothing behind it is compared.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("trust")).alias("t"), (-F.size("families")).alias("f"), "first_id", "value", "trust", "families")))
    best = found.groupBy(*key).agg(listed.alias("c")).select(*key, F.get("c", 0)["value"].alias("won"), F.get("c", 0)["trust"].alias("trust"), F.get("c", 0)["families"].alias("families"), F.slice("c", F.lit(2), F.size("c")).alias("lost"))
    rows = wanted.join(locks.select(*key, "lock_state"), key, "left").join(current.select(*key, F.col("value").alias("old_value")), key, "left").join(best, key, "left")
    kept = (
        F.when(F.col("lock_state") == "MANUAL", "Field locked as MANUAL by user")
        .when((F.col("lock_state") == "PROTECTED") & ~F.coalesce("by_user", F.lit(False)), "Field is PROTECTED and no user evidence present")
        .when(F.col("by_user").isNull(), "No evidence facts available")
        .when(F.col("won").isNull(), "All evidence values were invalid or placeholders")
    )
    chosen = F.concat(F.lit("Selected '"), F.col("won"), F.lit("' (Trust weight: "), F.format_string("%.2f", F.round(F.col("trust") + 1e-7, 2)), F.lit(", Families: ["), F.array_join("families", ", "), F.lit("])"))
    return rows.withColumn("kept", kept).select(
        *key,
        "old_value",
        F.when(F.col("kept").isNull(), F.col("won")).otherwise(F.col("old_value")).alias("selected_value"),
        F.when(F.col("kept").isNull(), F.col("trust")).alias("trust"),
        F.coalesce("kept", chosen).alias("reason"),
        F.when(F.col("kept").isNull(), F.to_json(F.transform(F.coalesce("lost", F.array()), lambda x: F.struct(x["value"].alias("value"), x["families"].alias("families"))))).otherwise("[]").alias("rejected"),
    )


def decision_hash(field: Column, facts: Column, selected: Column, version: str, config: str) -> Column:
    """Hash over the field, its facts (array of id and value) and the choice."""
    tokens = F.array_join(F.array_sort(F.transform(F.filter(facts, lambda e: e["id"].isNotNull()), lambda e: F.concat(e["id"].cast("string"), F.lit(":"), F.coalesce(e["value"], F.lit("None"))))), "|")
    return F.sha2(F.concat_ws("|", field, tokens, F.coalesce(selected, F.lit("")), F.lit(version), F.lit(config)).cast("binary"), 256)
