"""Text functions in DuckDB's SQL, for the statements that stand beside the queries."""

from __future__ import annotations

from tessera.functions import fixed


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def unquote(x: str) -> str:
    return f"trim({x}, {lit(fixed.QUOTES)})"


def sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def edition(x: str) -> str:
    return space(unquote(sub(f"lower(trim({blank(x)}))", fixed.EDITION_NOISE)))


def sanitize(x: str) -> str:
    return space(unquote(sub(f"trim({blank(x)})", fixed.FEATURED)))


def artist_key(x: str) -> str:
    return space(sub(f"replace(replace(replace(lower({sanitize(x)}), '’', ''''), '`', ''''), '&', ' and ')", r"^the\s+"))


def alnum(x: str) -> str:
    return f"lower({sub(blank(x), r'[^\p{L}\p{N}]')})"


def date(x: str) -> str:
    d = sub(blank(x), "[^0-9]")
    return f"CASE WHEN length({d}) >= 8 THEN substr({d}, 1, 4) || '-' || substr({d}, 5, 2) || '-' || substr({d}, 7, 2) WHEN length({d}) >= 4 THEN substr({d}, 1, 4) ELSE trim({blank(x)}) END"


def isrc(x: str) -> str:
    c = f"upper(trim(replace({blank(x)}, '-', '')))"
    return f"CASE WHEN regexp_matches({c}, {lit(fixed.ISRC)}) THEN {c} ELSE '' END"


def text(x: str) -> str:
    return space(unquote(f"lower(trim({blank(x)}))"))


def title(x: str) -> str:
    part = "lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))"
    return f"array_to_string(list_transform(string_split({space(blank(x))}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), {part}), '-')), ' ')"


def genre(x: str) -> str:
    return space(unquote(title(x)))


def decade(x: str) -> str:
    y = f"try_cast(substr({x}, 1, 4) AS INT)"
    return f"CASE WHEN {y} < 1970 THEN '< 1970s' " + " ".join(f"WHEN {y} BETWEEN {s} AND {s + 9} THEN '{s}s'" for s in range(1970, 2020, 10)) + f" WHEN {y} >= 2020 THEN '2020s' ELSE 'Unknown Era' END"


def region(x: str) -> str:
    return f"CASE upper(trim({x})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.COUNTRY_REGIONS.items()) + f" ELSE '{fixed.OTHER_REGION}' END"


def family(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SOURCE_FAMILIES.items()) + f" ELSE '{fixed.OTHER_FAMILY}' END"


def prior(field: str, family_: str) -> str:
    one = lambda table: f"CASE {family_} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {fixed.MISSING_PRIOR} END"
    return f"CAST(CASE {field} " + " ".join(f"WHEN '{k}' THEN {one(v)}" for k, v in fixed.FIELD_PRIORS.items()) + f" ELSE {one(fixed.DEFAULT_PRIORS)} END AS DOUBLE)"


def tag_weight(x: str) -> str:
    return f"CAST(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TAG_WEIGHTS.items()) + f" ELSE {fixed.OTHER_TAG_WEIGHT} END AS DOUBLE)"


def fallback(x: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(trim({blank(x)})), '{row[0]}') THEN '{row[k]}'" for row in fixed.ARTIST_GENRES) + f" ELSE '{fixed.OTHER_GENRES[k - 1]}' END"


def normalise(field: str, x: str) -> str:
    return f"CASE WHEN {field} IN ('title', 'album') THEN {edition(x)} WHEN {field} IN ('release_date', 'original_release_date') THEN {date(x)} WHEN {field} = 'isrc' THEN {isrc(x)} WHEN {field} IN ('genre', 'subgenre') THEN {genre(x)} ELSE {text(x)} END"
