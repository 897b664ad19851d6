"""Queries over providers' stored answers, the cache before them, retries, and one step of the crawler."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import crawl, mutate
from tessera.plans import duck
from tessera.plans.domain import CORE_TITLE, SEARCH_TITLE
from tessera.plans.registry import catalog_query as q
from tessera.plans.scans import overview
from tessera.plans.totals import affinity
from tessera.sources import payloads
from tessera.sources.fixtures import Catalog

NOW = "2024-02-20 00:00:00"
_KEY = "CAST(p_partkey AS VARCHAR) AS key"


def answers(rows: DataFrame, key, *body) -> DataFrame:
    """(key, body): JSON of the columns for each row."""
    return rows.select(key.cast("string").alias("key"), F.to_json(F.struct(*body)).alias("body"))


def value(column):
    return F.struct(column.cast("string").alias("value"))




def part():
    return F.col("p_partkey")


def store(t: Catalog) -> DataFrame:
    """Two answers to two keys of three, of two days each."""
    rows = t.part.where("p_partkey % 3 <> 0").select(part().cast("string").alias("key"), "p_name", F.explode(F.array(F.col("p_size"), F.floor(F.col("p_size") / 2).cast("int"))).alias("day"))
    return rows.select("key", F.concat("p_name", F.lit(" "), F.col("day").cast("string")).alias("body"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(day)").alias("stored_at"))


_STORE = "(SELECT p_partkey, p_name, unnest([p_size, p_size // 2]) AS day FROM part WHERE p_partkey % 3 <> 0)"
_FRESH = f"(SELECT p_partkey, p_name || ' ' || max(day) AS body FROM {_STORE} s WHERE day >= 43 GROUP BY p_partkey, p_name)"
q("src09_stored_payload", f"SELECT CAST(p.p_partkey AS VARCHAR) AS key, f.body FROM part p LEFT JOIN {_FRESH} f ON f.p_partkey = p.p_partkey")(lambda t: payloads.cached(t.part.select(part().cast("string").alias("key")), store(t), F.lit(NOW).cast("timestamp")))
q("ss06_single_flight", f"SELECT CAST(l_partkey AS VARCHAR) AS key, count(*) AS waiting FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM {_FRESH} f) GROUP BY l_partkey")(
    lambda t: payloads.to_fetch(payloads.cached(t.lineitem.select(F.col("l_partkey").cast("string").alias("key")), store(t), F.lit(NOW).cast("timestamp")))
)


def attempts(t: Catalog) -> DataFrame:
    """Three attempts for each part, most of them busy."""
    status = lambda k: F.when((part() + k) % 4 == 0, 200).when((part() + k) % 4 == 1, 404).when((part() + k) % 4 == 2, 429).otherwise(503)
    wait = lambda k: F.when((part() + k) % 5 == 0, F.lit("2.5")).when((part() + k) % 5 == 1, F.lit("soon"))
    tries = F.array(*[F.struct(F.lit(k).alias("attempt"), status(2 * k).alias("status"), wait(k).alias("retry_after")) for k in range(3)])
    return t.part.select(part().cast("string").alias("key"), F.explode(tries).alias("x")).select("key", "x.*")


_WAITS = "CASE (p_partkey + {0}) % 5 WHEN 0 THEN 2.5 ELSE 1.5 END"
q(
    "ss06_retries",
    f"SELECT key, tries, CAST(CASE tries WHEN 1 THEN 0 ELSE {_WAITS.format(0)} + CASE tries WHEN 3 THEN {_WAITS.format(1)} ELSE 0 END END AS DOUBLE) AS waited, (p_partkey + 2 * (tries - 1)) % 4 = 0 AS ok FROM (SELECT {_KEY}, p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 1 WHEN (p_partkey + 2) % 4 < 2 THEN 2 ELSE 3 END AS tries FROM part) p",
)(lambda t: payloads.retries(attempts(t)))

# Answers of each kind


def fingerprint_lookups(t: Catalog) -> DataFrame:
    """Answers with two results: an id alone, and one with two recordings."""
    rec = lambda shift: F.struct(F.concat(F.lit("mb"), part() + shift).alias("id"), F.concat("p_name", F.lit(" "), (part() % 3 + shift).cast("string")).alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("artists"))
    results = F.array(F.struct(F.concat(F.lit("a"), part()).alias("id"), F.lit(0.95).alias("score"), F.array().cast("array<struct<id:string,title:string,artists:array<struct<name:string>>>>").alias("recordings")), F.struct(F.concat(F.lit("b"), part()).alias("id"), (F.col("p_size") / 50).alias("score"), F.when(part() % 5 != 0, F.array(rec(0), rec(1))).alias("recordings")))
    body = F.to_json(F.struct(F.when(part() % 11 == 0, "error").otherwise("ok").alias("status"), results.alias("results")))
    return t.part.select(part().cast("string").alias("key"), body.alias("body"), F.when(part() % 2 == 0, F.col("p_brand")).alias("artist"), F.col("p_name").alias("title"))


q("cn01_fingerprint")(lambda t: payloads.fingerprint_matches(fingerprint_lookups(t)))
q("cn02_by_code", f"SELECT {_KEY}, 'm' || p_partkey AS mbid, p_name AS title FROM part WHERE p_partkey % 7 <> 0")(
    lambda t: payloads.recordings_by_code(answers(t.part, part(), F.when(part() % 7 != 0, F.array(F.struct(F.concat(F.lit("m"), part()).alias("id"), F.col("p_name").alias("title")), F.struct(F.lit("x").alias("id"), F.lit("y").alias("title")))).alias("recordings")))
)
q("cn02_by_id", f"SELECT {_KEY}, 'm' || p_partkey AS mbid, p_name AS title, CAST(p_size * 10 AS DOUBLE) AS seconds, p_brand || ',I2' AS isrcs, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS tags FROM part WHERE p_partkey % 7 <> 0")(
    lambda t: payloads.recording(answers(t.part, part(), F.when(part() % 7 != 0, F.concat(F.lit("m"), part())).alias("id"), F.col("p_name").alias("title"), (F.col("p_size") * 10_000).alias("length"), F.array("p_brand", F.lit("I2")).alias("isrcs"), F.when(part() % 2 == 0, F.array(F.struct(F.col("p_type").alias("name")))).alias("tags"))).withColumn("isrcs", F.array_join("isrcs", ",")).withColumn("tags", F.array_join("tags", ","))
)


def search_answers(t: Catalog) -> DataFrame:
    """Answers to two tiers of a search: the first empty for every third part."""
    hit = lambda shift, far: F.struct(F.concat(F.lit("h"), part() * 10 + shift).alias("id"), F.concat(F.lit("Track "), ((part() + shift) % 9).cast("string")).alias("title"), (F.lit(200_000) + far).cast("double").alias("length"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("artist-credit"))
    tiers = F.array(F.when(part() % 3 != 0, F.array(hit(0, 70_000), hit(1, 20_000), hit(2, 0))), F.array(hit(3, 0), hit(4, 10_000)))
    rows = t.part.select(part().cast("string").alias("key"), F.posexplode(tiers).alias("tier", "hits"))
    return rows.select("key", "tier", F.to_json(F.struct(F.col("hits").alias("recordings"))).alias("body"))


def searched(t: Catalog) -> DataFrame:
    return t.part.select(part().cast("string").alias("key"), F.concat(F.lit("Track "), (part() % 9).cast("string")).alias("title"), F.when(part() % 4 != 0, F.col("p_brand")).alias("artist"), F.when(part() % 5 != 0, 200.0).alias("seconds"))


def _clean(x: str) -> str:
    return duck.space(duck.sub(f"replace(replace({x}, '’', ''''), '`', '''')", r'[+\-&|!(){}\[\]^"~*?:\\/]', " "))


_PLAIN = f"(SELECT r.id, {SEARCH_TITLE} AS whole, {CORE_TITLE} AS middle, {duck.sanitize('name')} AS artist FROM core_recordings r LEFT JOIN (SELECT id AS artist_id, name FROM core_artists) a ON a.artist_id = r.artist_id)"
_TERMS = f"(SELECT id, {_clean('whole')} AS whole, {_clean('middle')} AS core, {_clean('coalesce(artist, ' + duck.lit('') + ')')} AS who FROM {_PLAIN} p)"
_KNOWN = "core <> '' AND who <> '' AND lower(who) <> 'unknown artist'"
q(
    "cn02_search_tiers",
    f"""WITH t AS (SELECT * FROM {_TERMS} x) SELECT id AS key, 0 AS tier, 'recording:"' || core || '" AND artist:"' || who || '"' AS query FROM t WHERE {_KNOWN}
    UNION ALL SELECT id, 1, 'recording:"' || whole || '" AND artist:"' || who || '"' FROM t WHERE whole <> '' AND whole <> core AND who <> '' AND lower(who) <> 'unknown artist' UNION ALL SELECT id, 2, 'recording:(' || core || ') AND artist:(' || who || ')' FROM t WHERE {_KNOWN}
    UNION ALL SELECT id, 3, '"' || core || '" AND "' || who || '"' FROM t WHERE {_KNOWN} UNION ALL SELECT id, 4, 'recording:"' || core || '"' FROM t WHERE core <> ''""",
)(lambda t: payloads.search_queries(t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left").select(F.col("id").alias("key"), "title", "artist")))
q("cn02_search")(lambda t: payloads.best_hits(searched(t), payloads.search_hits(search_answers(t))))
q("cn03_release_group", f"SELECT {_KEY}, 'g' || p_partkey AS mbid, CASE WHEN p_partkey % 2 = 0 THEN '1999-01-0' || (p_partkey % 9 + 1) END AS first_release_date FROM part WHERE p_partkey % 7 <> 0")(
    lambda t: payloads.release_groups(answers(t.part, part(), F.when(part() % 7 != 0, F.array(F.struct(F.concat(F.lit("g"), part()).alias("id"), F.when(part() % 2 == 0, F.concat(F.lit("1999-01-0"), part() % 9 + 1)).alias("first-release-date")), F.struct(F.lit("z").alias("id"), F.lit("z").alias("first-release-date")))).alias("release-groups")))
)


def release_answers(t: Catalog) -> DataFrame:
    """Releases of two media: a titled track with codes, and one that only its recording names."""
    none = F.lit(None).cast("string")
    track = lambda n, title, mbid, name, codes: F.struct(F.lit(n).alias("position"), title.alias("title"), F.struct(mbid.alias("id"), name.alias("title"), codes.cast("array<string>").alias("isrcs")).alias("recording"))
    one, two = track(1, F.col("p_name"), F.concat(F.lit("r"), part()), none, F.array(F.concat(F.lit("I"), part()), F.lit("X"))), track(2, F.lit(""), none, F.col("p_type"), F.array())
    return answers(t.part, part(), F.array(F.struct(F.array(one).alias("tracks")), F.struct(F.array(two).alias("tracks"))).alias("media"))


def group_answers(t: Catalog) -> DataFrame:
    """Groups with two releases, some of which have none or no tags."""
    named = lambda *names: F.array(*[F.struct(n.alias("name")) for n in names])
    releases = F.when(part() % 7 != 0, F.array(F.struct(F.concat(F.lit("rel"), part()).alias("id")), F.struct(F.lit("other").alias("id"))))
    return answers(t.part, part(), F.when(part() % 2 == 0, "1999-01-05").alias("first-release-date"), F.when(part() % 3 != 0, named(F.col("p_type"), F.lit(""), F.col("p_brand"))).alias("tags"), releases.alias("releases"))


def first_releases(t: Catalog) -> DataFrame:
    """The first releases' answers, one of five missing: tracks as in release_answers, tags that the group has too."""
    body = F.from_json("body", "struct<media:array<struct<tracks:array<struct<position:int,title:string,recording:struct<id:string,title:string,isrcs:array<string>>>>>>>")
    rows = release_answers(t).join(t.part.select(part().cast("string").alias("key"), "p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"), (part() % 5).alias("r")).hint("merge"), "key").where("r <> 0").withColumn("j", body)
    tags = F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("size").alias("name")))
    return rows.select(F.concat(F.lit("rel"), "key").alias("key"), F.to_json(F.struct(tags.alias("tags"), F.when(F.col("r") != 1, F.col("j.media")).alias("media"))).alias("body"))


q(
    "cn03_release",
    f"""SELECT {_KEY}, CASE WHEN p_partkey % 2 = 0 THEN '1999-01-05' END AS first_release_date, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 3 <> 0 THEN [p_type, p_brand, 'size ' || p_size] ELSE [p_brand, 'size ' || p_size] END)), ',') AS tags,
    CASE WHEN p_partkey % 5 = 1 THEN '' ELSE '1|' || p_name || '|r' || p_partkey || '|I' || p_partkey || ';2|' || p_type || '|-|-' END AS tracks FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0""",
)(lambda t: payloads.release_details(group_answers(t), first_releases(t)).select("key", "first_release_date", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("tracks", lambda x: F.concat_ws("|", x["position"].cast("string"), x["title"], F.coalesce(x["mbid"], F.lit("-")), F.coalesce(x["isrc"], F.lit("-")))), ";").alias("tracks")))
q("cn03_tracklist", f"SELECT {_KEY}, 1 AS disc, 1 AS position, p_name AS title, 'r' || p_partkey AS mbid, 'I' || p_partkey AS isrc FROM part UNION ALL SELECT {_KEY}, 2, 2, p_type, NULL, NULL FROM part")(lambda t: payloads.tracklists(release_answers(t)))
q("cn04_artist_facts", f"SELECT {_KEY}, CASE WHEN p_partkey % 7 <> 0 THEN 'Q' || p_partkey END AS qid, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN 'FR' END AS country, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS gender, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS artist_type, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN 1900 + p_partkey % 100 END AS formed_year FROM part")(
    lambda t: payloads.artist_facts(
        answers(t.part, part(), F.struct(F.when(part() % 7 != 0, F.array(F.struct(value(F.concat(F.lit("Q"), part())).alias("wikidataQID"), F.when(part() % 2 == 0, value(F.lit("FR"))).alias("countryCode"), value(F.when(part() % 3 != 0, F.concat((part() % 100 + 1900).cast("string"), F.lit("-05-01T00:00:00Z"))).otherwise("unknown")).alias("inception"), value(F.col("p_brand")).alias("genderLabel"), value(F.col("p_type")).alias("artistTypeLabel")))).otherwise(F.array().cast("array<struct<wikidataQID:struct<value:string>,countryCode:struct<value:string>,inception:struct<value:string>,genderLabel:struct<value:string>,artistTypeLabel:struct<value:string>>>")).alias("bindings")).alias("results"))
    )
)
q("cn05_track_codes", f"SELECT {_KEY}, 'USABC' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS isrc FROM part WHERE p_partkey % 4 <> 0")(lambda t: payloads.track_codes(answers(t.part, part(), F.array(F.struct(F.when(part() % 4 != 0, F.concat(F.lit("usabc"), F.lpad(part().cast("string"), 7, "0"))).otherwise("short").alias("isrc")), F.struct(F.lit("USABC0000000").alias("isrc"))).alias("data"))))
q("cn06_store_tracks", f"SELECT {_KEY}, p_name AS album, p_type AS genre, CASE WHEN p_partkey % 2 = 0 THEN '2001-02-03' END AS release_date FROM part WHERE p_partkey % 7 <> 0")(
    lambda t: payloads.store_tracks(answers(t.part, part(), F.when(part() % 7 != 0, F.array(F.struct(F.col("p_name").alias("collectionName"), F.col("p_type").alias("primaryGenreName"), F.when(part() % 2 == 0, "2001-02-03T07:00:00Z").otherwise("").alias("releaseDate")))).alias("results")))
)
q("cn07_release_search", f"SELECT {_KEY}, p_brand AS catno, CASE WHEN p_partkey % 2 = 0 THEN '7 24' END AS barcode, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Style,' || p_type END AS styles FROM part WHERE p_partkey % 7 <> 0")(
    lambda t: payloads.release_search(answers(t.part, part(), F.when(part() % 7 != 0, F.array(F.struct(F.col("p_brand").alias("catno"), F.when(part() % 2 == 0, F.array(F.lit(" 7 24 "), F.lit("9"))).alias("barcode"), F.when(part() % 3 != 0, F.array(F.lit("Style"))).alias("style"), F.array("p_type").alias("genre")))).alias("results"))).withColumn("styles", F.array_join("styles", ","))
)


def tag_answers(t: Catalog) -> DataFrame:
    tags = F.transform(F.sequence(F.lit(0), F.col("p_size") % 12), lambda k: F.struct(F.when(k == 2, "").otherwise(F.concat(F.lit("tag "), k.cast("string"))).alias("name"), F.when(k % 3 == 0, "many").otherwise((100 - k).cast("string")).alias("count")))
    return answers(t.part, part(), F.struct(tags.alias("tag")).alias("toptags"))


q("cn08_top_tags", f"SELECT {_KEY}, CAST(k AS INT) AS n, 'tag ' || k AS tag, CAST(CASE WHEN k % 3 = 0 THEN 50 ELSE 100 - k END AS DOUBLE) AS weight FROM part, range(8) r(k) WHERE k <= p_size % 12 AND k <> 2")(lambda t: payloads.top_tags(tag_answers(t)))

def with_seed(t: Catalog) -> DataFrame:
    """Parts as seeds: an identifier of 36 characters for all but every fifth."""
    mark = F.md5(part().cast("string").cast("binary"))
    long = F.concat_ws("-", F.substring(mark, 1, 8), F.substring(mark, 9, 4), F.substring(mark, 13, 4), F.substring(mark, 17, 4), F.substring(mark, 21, 12))
    return t.part.withColumn("seed", F.when(part() % 5 != 0, long).otherwise(F.col("p_name")))


_SEED_SQL = "(SELECT *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS seed FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS m FROM part) x)"
q("cn09_discography", f"SELECT seed AS key, 'Record ' || k AS title, p_brand AS artist_name, 'g' || k AS mbid, 'Discography' AS genre FROM {_SEED_SQL} s, range(1, 3) r(k) WHERE p_partkey % 5 <> 0")(lambda t: payloads.discography(discography_answers(t)))


def discography_answers(t: Catalog) -> DataFrame:
    group = lambda k: F.struct(F.lit(f"g{k}").alias("id"), F.lit(f"Record {k}").alias("title"))
    unnamed = F.struct(F.lit("g9").alias("id"), F.lit("").alias("title"))
    return with_seed(t).select(F.col("seed").alias("key"), F.col("p_brand").alias("entity_name"), F.to_json(F.struct(F.array(group(1), group(2), unnamed).alias("release-groups"))).alias("body"))


def network_answers(t: Catalog) -> DataFrame:
    """As many bindings as the part's size, of which forty count."""
    row = lambda k: F.struct(value(F.concat(F.lit("http://x/entity/Q"), k.cast("string"))).alias("releaseGroup"), value(F.concat(F.lit("Album "), k.cast("string"))).alias("title"), value(F.concat("p_brand", F.lit(" "), (k % 3).cast("string"))).alias("similarArtistLabel"), F.when(k % 2 == 0, value(F.col("p_type"))).alias("genreLabel"))
    return answers(t.part, part(), F.struct(F.transform(F.sequence(F.lit(1), F.col("p_size")), row).alias("bindings")).alias("results"))


q("cn09_genre_network", f"SELECT {_KEY}, 'Album ' || k AS title, p_brand || ' ' || (k % 3) AS artist_name, 'Q' || k AS mbid, CASE WHEN k % 2 = 0 THEN p_type ELSE 'Unclassified' END AS genre FROM part, range(1, 41) r(k) WHERE k <= p_size")(lambda t: payloads.genre_network(network_answers(t)))


def similar_answers(t: Catalog) -> DataFrame:
    names = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.when(k == 1, "").otherwise(F.concat(F.lit("Brand#"), ((part() + k) % 25 + 11).cast("string"))).alias("name")))
    return answers(t.part, part(), F.struct(names.alias("artist")).alias("similarartists"))


def album_answers(t: Catalog) -> DataFrame:
    """Five albums for each of 25 names, of which four count and one has no name."""
    album = lambda k: F.struct(F.when(k == 3, "(NULL)").otherwise(F.concat(F.lit("Top "), k.cast("string"))).alias("name"), F.when(k == 0, F.repeat(F.lit("f"), 36)).otherwise("short").alias("mbid"))
    names = t.spark.range(11, 36).select(F.concat(F.lit("Brand#"), "id").alias("name"))
    return names.select("name", F.to_json(F.struct(F.struct(F.transform(F.sequence(F.lit(0), F.lit(4)), album).alias("album")).alias("topalbums"))).alias("body"))


q("cn09_similar", f"SELECT {_KEY}, 'Top ' || a.k AS title, 'Brand#' || ((p_partkey + s.k) % 25 + 11) AS artist_name, CASE WHEN a.k = 0 THEN repeat('f', 36) END AS mbid, 'Similar' AS genre FROM part, (VALUES (0), (2)) s(k), range(3) a(k)")(lambda t: payloads.similar_albums(payloads.similar_artists(similar_answers(t)), album_answers(t)))
q("cn09_names", f"SELECT {_KEY}, 'm' || p_partkey AS mbid FROM part WHERE p_partkey % 6 <> 0")(lambda t: payloads.artist_ids(answers(t.part, part(), F.when(part() % 6 != 0, F.array(F.struct(F.concat(F.lit("m"), part()).alias("id")), F.struct(F.lit("z").alias("id")))).alias("artists"))))


@q(
    "cn10_genre_seeds",
    "SELECT coalesce(CAST(f.seed_id AS VARCHAR), n.seed) AS seed_id, coalesce(f.entity_name, n.name) AS entity_name, CASE WHEN n.seed IS NULL THEN f.priority ELSE 1.2 END AS priority, CASE WHEN n.seed IS NULL THEN f.state ELSE 'PENDING' END AS state FROM sys_crawl_frontier f FULL JOIN (SELECT DISTINCT CAST(n_nationkey * 2 AS VARCHAR) AS seed, 'Artist ' || n_nationkey AS name FROM nation WHERE n_nationkey BETWEEN 1 AND 15) n ON CAST(f.seed_id AS VARCHAR) = n.seed",
)
def genre_seed_harvest(t: Catalog) -> DataFrame:
    """Seeds of a genre's answer go to the front of the frontier, those that are there too."""
    rows = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda k: F.struct(value(k * 2).alias("artistMBID"), value(F.concat(F.lit("Artist "), k.cast("string"))).alias("artistLabel")))
    seeds = payloads.genre_seeds(answers(t.region.where("r_regionkey = 0"), F.col("r_regionkey"), F.struct(rows.alias("bindings")).alias("results")))
    frontier = t.sys_crawl_frontier.select(F.col("seed_id").cast("string").alias("seed_id"), "entity_name", "priority", "state")
    return mutate.upsert(frontier, seeds.withColumn("priority", F.lit(1.2)).withColumn("state", F.lit("PENDING")), ["seed_id"], ["priority", "state"])


# The crawler


def crawled(t: Catalog) -> dict[str, DataFrame]:
    """One step over a frontier of parts, a fifth of them names that a search has to find."""
    rows = with_seed(t)
    named = F.concat(F.lit("name:"), "p_name", F.lit("/"), part())
    frontier = rows.select(F.when(part() % 5 != 0, F.col("seed")).otherwise(named).alias("seed_id"), F.col("p_brand").alias("entity_name"), (F.col("p_size") / 50).alias("priority"), F.when(part() % 9 == 0, "COOLDOWN").otherwise("PENDING").alias("state"), part().alias("created_seq"))
    frontier = crawl.harvest(frontier, t.core_artists, t.core_recordings, t.meta_validation)
    said = {
        "artist_search": rows.where("p_partkey % 5 = 0").select(named.alias("key"), F.to_json(F.struct(F.when(part() % 10 == 0, F.array(F.struct(F.concat(F.lit("found "), part()).alias("id")))).alias("artists"))).alias("body")),
        "discography": discography_answers(t).select("key", "body"),
        "genre_network": network_answers(t).join(rows.select(part().cast("string").alias("key"), "seed").hint("merge"), "key").select(F.col("seed").alias("key"), "body"),
        "similar": similar_answers(t).join(rows.select(part().cast("string").alias("key"), "p_brand").hint("merge"), "key").groupBy(F.col("p_brand").alias("key")).agg(F.min("body").alias("body")),
        "albums": album_answers(t),
    }
    lib = overview(t).select("title", "artist_name").distinct()
    from tessera.functions import text

    owned = lib.where("title <> ''").select(text.alnum_key(F.col("title")).alias("kt"), text.alnum_key(F.col("artist_name")).alias("ka"))
    return crawl.crawl_batch(frontier, said, t.sys_discovery_candidates, owned, affinity(t.core_recordings), n=20)


q("ss03_crawl_frontier")(lambda t: crawled(t)["frontier"])
q("ss03_crawl_candidates")(lambda t: crawled(t)["candidates"])
