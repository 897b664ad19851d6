"""Pairs of similar texts by inverted lists of their pairs of letters.

Two texts that ``d`` edits lead into one another share all but 2 d of the larger one's letter pairs, repeats counted. So if all texts
put their pairs in one order, rare ones first, some pair is among the first 2 d + 1 of both: only these prefixes are joined, and a pair
of letters that very many texts have is in few of them. Texts so short that they may share none meet in a list of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram.
Q = 2


def _grams(text: Column) -> Column:
    """The grams of a text as (gram, how many equal ones stand before it)."""
    plain = F.when(F.length(text) >= Q, F.transform(F.sequence(F.lit(1), F.length(text) - (Q - 1)), lambda i: F.substring(text, i, F.lit(Q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(plain, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(plain, 1, i), lambda other: other == g)).alias("nth")))


def _prefixes(texts: DataFrame, edits: Callable[[Column], Column]) -> DataFrame:
    """(block, text, n, token): the rarest grams of each text of (block, text); n: its length."""
    grams = texts.select("block", "text", F.explode(_grams(F.col("text"))).alias("g"))
    often = grams.groupBy("block", "g").agg(F.count("*").alias("often"))
    rare = F.sort_array(F.collect_list(F.struct("often", "g")))
    most = Q * edits(F.length("text"))
    ranked = grams.join(often, ["block", "g"]).groupBy("block", "text").agg(rare.alias("rare"))
    tokens = ranked.select("block", "text", F.length("text").alias("n"), F.explode(F.slice("rare", 1, most + 1)).alias("x")).select("block", "text", "n", F.col("x.g").alias("token"))
    # No more grams than edits may change: any of these may be near any other such text.
    none = F.struct(F.lit("").alias("gram"), F.lit(0).alias("nth"))
    short = texts.where(F.greatest(F.length("text") - (Q - 1), F.lit(0)) <= most).select("block", "text", F.length("text").alias("n"), none.alias("token"))
    return tokens.unionByName(short)


def near_candidates(left: DataFrame, right: DataFrame, edits: Callable[[Column], Column], apart: Callable[[Column, Column], Column]) -> DataFrame:
    """(block, a, b): every pair of texts of one block, left's (block, text) and right's, that may be near; a superset, each pair once.

    edits: from a text's length to the most letters that are inserted, removed or replaced on the way to any near text. apart:
    whether two lengths rule a pair out. Null texts are near nothing.
    """
    rows = lambda frame: frame.select("block", "text").where("text IS NOT NULL").distinct()
    left, right = rows(left).withColumn("mine", F.lit(True)), rows(right).withColumn("theirs", F.lit(True))
    both = left.join(right, ["block", "text"], "full")
    tokens = _prefixes(both.select("block", "text"), edits).join(both, ["block", "text"])
    a = tokens.where("mine").select("block", "token", F.col("text").alias("a"), F.col("n").alias("na"))
    b = tokens.where("theirs").select("block", "token", F.col("text").alias("b"), F.col("n").alias("nb"))
    return a.join(b, ["block", "token"]).where(~apart(F.col("na"), F.col("nb"))).select("block", "a", "b").distinct()


def within_edits(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(block, a, b) of the texts of one block that at most so many insertions, removals and replacements of letters part."""
    found = near_candidates(left, right, lambda n: F.lit(most), lambda na, nb: F.abs(na - nb) > most)
    return found.where(F.levenshtein("a", "b") <= most)


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, a, b) of texts of letters and digits that may have a share of ``least`` of their letters in common, in order: 2 m / (na + nb).

    A superset, for a similarity that counts no more than the longest common subsequence.
    """
    # What isn't in common is removed or inserted; the longest partner of n letters has n (2 / least - 1).
    edits = lambda n: F.floor((1 - least) * (n + F.floor(n * (2 / least - 1) + 1e-9)) + 1e-9).cast("int")
    return near_candidates(left, right, edits, lambda na, nb: 2 * F.least(na, nb) < least * (na + nb) - 1e-9)
