"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import exact, text


def one(spark, function, *values):
    kinds = ", ".join(f"c{k} {'int' if isinstance(v, int) else 'string'}" for k, v in enumerate(values))
    frame = spark.createDataFrame([values], kinds)
    return frame.select(function(*[F.col(c) for c in frame.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (text.normal_date, "2011-03-05", "2011-03-05"),
        (text.normal_date, "1975", "1975"),
        (text.normal_date, "c. 99", "c. 99"),
        (text.normal_date, None, ""),
        (text.normal_isrc, "us-abc-12-34567", "USABC1234567"),
        (text.normal_isrc, "US12", ""),
        (text.normal_isrc, "unknown", ""),
        (text.title_case, "singer-songwriter ROCK", "Singer-Songwriter Rock"),
        (text.artist_key, "The The feat. X", "the"),
        (text.artist_key, "Simon & Garfunkel", "simon and garfunkel"),
        (text.strip_edition_noise, "Song (2011 Remastered)", "song"),
        (text.core_title, "Song: part two [live]...", "Song"),
        (text.search_title, "Part I-V (Remaster) feat. X", "Part 1-5"),
        (text.path_seed, "/a/03 - My_Song (Remastered).flac", "My Song"),
        (text.disc_number, "/vinyl b/x.mp3", 2),
        (text.disc_number, "/cd 3/x.mp3", 3),
        (text.disc_number, "/x.mp3", 1),
        (text.region, "gb", "Europe"),
        (text.region, "SOUTH KOREA", "East Asia"),
        (text.region, "xx", "Global"),
        (text.region, None, "Global"),
        (text.decade, "1969-01-01", "< 1970s"),
        (text.decade, "n. d.", "Unknown Era"),
        (text.clock, 59, "00:59"),
        (text.clock, 61, "01:01"),
        (text.clock, 3661, "1:01:01"),
        (text.clock, 0, "--:--"),
        (text.deficit, 0, 1.00),
        (text.deficit, 5, 0.65),
        (text.deficit, 20, 0.35),
        (text.saturation, 4, 1.00),
        (text.saturation, 5, 0.80),
        (text.saturation, 15, 0.60),
        (text.saturation, 30, 0.40),
        (exact.tag_alias, "  Électro_pop ", "electro pop"),
        (exact.slug, "Å b--c!", "a_b_c"),
        (exact.casefold, "Straße", "strasse"),
    ],
)
def test_value(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_similarity_minds_the_order():
    assert exact.ratio("tide", "diet") == 0.25
    assert exact.ratio("diet", "tide") == 0.50
    assert exact.ratio(None, "x") == 0.0 and exact.ratio("A-b", "ab") == 1.0


def test_gzip_round_trip(spark):
    frame = spark.createDataFrame([("a",), (None,), ("é" * 1000,)], "x string")
    assert [r.y for r in frame.select(exact.gunzip(exact.gzipped("x")).alias("y")).collect()] == ["a", None, "é" * 1000]
