"""Scalar functions over text, identifiers, dates and numbers, as Spark columns.

Case folding is lower(): the same for all but a few letters (tessera.functions.exact folds those too).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed

def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquote(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.QUOTES))


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def or_default(text: Column, default: Column) -> Column:
    """The default for null and for the empty text."""
    return F.when(text.isNull() | (text == ""), default).otherwise(text)


def strip_edition_noise(title: Column) -> Column:
    return one_space(unquote(F.regexp_replace(F.lower(F.trim(or_blank(title))), fixed.EDITION_NOISE, "")))


def is_canonical_title(title: Column) -> Column:
    return ~F.rlike(or_blank(title), F.lit(fixed.EDITION_WORD))


def sanitize_artist(name: Column) -> Column:
    return one_space(unquote(F.regexp_replace(F.trim(or_blank(name)), fixed.FEATURED, "")))


def artist_key(name: Column) -> Column:
    key = F.replace(F.translate(F.lower(sanitize_artist(name)), "’`", "''"), F.lit("&"), F.lit(" and "))
    return one_space(F.regexp_replace(key, r"^the\s+", ""))


def path_seed(path: Column) -> Column:
    name = F.substring_index(or_blank(path), "/", -1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    text = F.regexp_replace(F.regexp_replace(F.trim(stem), fixed.SEED_PREFIX, ""), fixed.EDITION_NOISE, "")
    return one_space(F.regexp_replace(text, r"[._\-]", " "))


def disc_number(path: Column) -> Column:
    value = F.regexp_extract(F.lower(or_blank(path)), fixed.DISC, 2)
    side = F.when(F.rlike(value, F.lit("^[a-d]$")), F.ascii(value) - F.ascii(F.lit("a")) + 1)
    return F.coalesce(F.when(F.rlike(value, F.lit("^[0-9]+$")), value.try_cast("int")), side, F.lit(1))


def alnum_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(or_blank(text), r"[^\p{L}\p{N}]", ""))


def normal_date(text: Column) -> Column:
    digits = F.regexp_replace(or_blank(text), r"[^0-9]", "")
    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) >= 8, day).when(F.length(digits) >= 4, F.substring(digits, 1, 4)).otherwise(F.trim(or_blank(text)))


def normal_isrc(text: Column) -> Column:
    code = F.upper(F.trim(F.replace(or_blank(text), F.lit("-"), F.lit(""))))
    return F.when(F.rlike(code, F.lit(fixed.ISRC)), code).otherwise(F.lit(""))


def normal_mbid(text: Column) -> Column:
    found = F.lower(F.regexp_extract(or_blank(text), f"({fixed.UUID})", 1))
    return F.when(found != "", found).otherwise(F.substring(F.trim(or_blank(text)), 1, 64))


def normal_text(text: Column) -> Column:
    return one_space(unquote(F.lower(F.trim(or_blank(text)))))


def title_case(text: Column) -> Column:
    """Each part of each word capitalised, parts cut at hyphens."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")
    return F.array_join(F.transform(F.split(one_space(or_blank(text)), " "), word), " ")


def normal_genre(text: Column) -> Column:
    return one_space(unquote(title_case(text)))


#: Normalisers of fields; all other fields take normal_text.
NORMALISERS = {
    "title": strip_edition_noise,
    "album": strip_edition_noise,
    "release_date": normal_date,
    "original_release_date": normal_date,
    "isrc": normal_isrc,
    "musicbrainz_recording_id": normal_mbid,
    "musicbrainz_release_id": normal_mbid,
    "musicbrainz_artist_id": normal_mbid,
    "genre": normal_genre,
    "subgenre": normal_genre,
}


def normalise(field: Column, value: Column) -> Column:
    """The value by its field's normaliser."""
    chain = reduce(lambda c, item: c.when(field == item[0], item[1](value)), NORMALISERS.items(), F.when(field.isNull(), normal_text(value)))
    return chain.otherwise(normal_text(value))


def search_title(title: Column) -> Column:
    text = F.regexp_replace(unquote(F.translate(F.trim(or_blank(title)), "’`", "''")), r"[–—\-]", " ")
    text = F.regexp_replace(text, r"(?i)\bPart\s+I\s*[\-–—]?\s*V\b", "Part 1-5")
    text = F.regexp_replace(text, r"(?i)\bPart\s+VI\s*[\-–—]?\s*IX\b", "Part 6-9")
    text = F.regexp_replace(F.regexp_replace(text, fixed.SEARCH_NOISE, ""), r"(?i)\s+(feat\.?|ft\.?)\s+.*$", "")
    return one_space(F.replace(F.replace(text, F.lit("/"), F.lit(" ")), F.lit("&"), F.lit("and")))


def core_title(title: Column) -> Column:
    text = F.trim(F.regexp_replace(search_title(title), r"\s*[(\[{].*?[)\]}]\s*", " "))
    text = F.trim(F.regexp_replace(text, r"\s*:\s*.*$", ""))
    return one_space(F.regexp_replace(text, r"\.+$", ""))


def query_text(text: Column) -> Column:
    """Without the characters that a search query gives a meaning."""
    return one_space(F.regexp_replace(F.translate(or_blank(text), "’`", "''"), r'[+\-&|!(){}\[\]^"~*?:\\/]', " "))


def year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def decade(date: Column) -> Column:
    y = year(date)
    out = F.when(y < 1970, "< 1970s")
    for start in range(1970, 2020, 10):
        out = out.when(y.between(start, start + 9), f"{start}s")
    return out.when(y >= 2020, "2020s").otherwise("Unknown Era")


def fallback_genres(artist: Column) -> tuple[Column, Column]:
    name = F.lower(F.trim(or_blank(artist)))
    # A name with "can" in it is found by that before the two longer words that hold it.
    pick = lambda k: reduce(lambda c, row: c.when(F.contains(name, F.lit(row[0])), row[k]), fixed.ARTIST_GENRES[1:], F.when(F.contains(name, F.lit(fixed.ARTIST_GENRES[0][0])), fixed.ARTIST_GENRES[0][k])).otherwise(fixed.OTHER_GENRES[k - 1])
    return pick(1), pick(2)


def deficit(count: Column) -> Column:
    return F.when(count == 0, 1.00).when(count < 5, 0.85).when(count < 20, 0.65).otherwise(0.35)


def saturation(count: Column) -> Column:
    return F.when(count >= 30, 0.40).when(count >= 15, 0.60).when(count >= 5, 0.80).otherwise(1.00)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    text = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
    return F.when(F.coalesce(s, F.lit(0)) <= 0, "--:--").otherwise(text.otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60)))


def region(country: Column) -> Column:
    """Region of a country code or name; Global where it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in fixed.COUNTRY_REGIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(F.trim(country))), F.lit(fixed.OTHER_REGION))


def candidate_id(title: Column, artist: Column) -> Column:
    return F.concat(F.lit("cand_"), F.substring(F.md5(F.concat(title, artist).cast("binary")), 1, 10))


def query_hash(params: Column) -> Column:
    """Hash of a map of parameters, sorted by name, without secrets."""
    kept = F.filter(F.map_entries(params), lambda e: ~e["key"].isin("apikey", "api_key", "token", "client", "key", "secret"))
    pairs = F.transform(F.array_sort(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.array_join(pairs, "&").cast("binary"), 256)


#: Digits of base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(value: Column, digits: int) -> Column:
    digit = lambda i: F.substring(F.lit(CROCKFORD), F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(i) for i in range(digits - 1, -1, -1)])


def stable_ulid(millis: Column, key: Column) -> Column:
    """An identifier of 26 characters that sorts by time: ten of the milliseconds, sixteen of a hash of the key, the same on every run."""
    half = lambda start: F.conv(F.substring(F.md5(key.cast("binary")), start, 10), 16, 10).cast("long")
    return F.concat(_base32(millis.cast("long"), 10), _base32(half(1), 8), _base32(half(11), 8))
