"""Providers' answers as stored JSON: cached lookup, what is left to fetch, and each kind of answer as rows.

Live calls aren't made here. A table of payloads (key, body, stored_at) stands for the cache of answers, and each function
below turns the bodies of one kind into columns; a body that isn't of the kind gives nulls or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Seconds that an answer counts as fresh, and tries for one request with the wait before each further one.
LIFETIME, TRIES, WAIT = 7 * 86_400, 3, 1.5


def cached(requests: DataFrame, payloads: DataFrame, now: Column, lifetime: int = LIFETIME) -> DataFrame:
    """Requests (key and more) with the body of their newest answer that is still fresh, or null."""
    fresh = payloads.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= lifetime).groupBy("key").agg(F.max_by("body", F.struct("stored_at", "body")).alias("body"))
    return requests.join(fresh, "key", "left")


def to_fetch(looked_up: DataFrame) -> DataFrame:
    """(key, waiting): each key without an answer once, with the number of requests that wait for it."""
    return looked_up.where("body IS NULL AND key IS NOT NULL").groupBy("key").agg(F.count("*").alias("waiting"))


def retries(attempts: DataFrame) -> DataFrame:
    """(key, tries, waited, ok): requests from their attempts (key, attempt from 0, status, retry_after text).

    A status of 429 or 503 is tried again after retry_after seconds, or 1.5 where that isn't a number, up to three tries; any
    other status ends the request, and attempts after its end don't count.
    """
    again = F.col("status").isin(429, 503) & (F.col("attempt") < TRIES - 1)
    order = Window.partitionBy("key").orderBy("attempt")
    ended = F.coalesce(F.max((~again).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    made = attempts.withColumn("ended", ended).where("NOT ended").withColumn("wait", F.when(again, F.coalesce(F.col("retry_after").try_cast("double"), F.lit(WAIT))).otherwise(0.0))
    return made.groupBy("key").agg(F.count("*").alias("tries"), F.round(F.sum("wait"), 3).alias("waited"), F.max_by(F.col("status").between(200, 299), "attempt").alias("ok"))


def _json(body: Column, schema: str) -> Column:
    return F.from_json(body, schema)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def fingerprint_matches(lookups: DataFrame) -> DataFrame:
    """(key, acoustid, mbid, score) from lookups (key, body, artist, title): the best recording among the results, else the best id alone.

    A recording scores raw times 0.35 of the artist's likeness, 0.35 of the title's and 0.30 of raw; likeness is 0.85 where a name is missing.
    The first of equal scores wins.
    """
    from tessera.functions.exact import similarity

    schema = "struct<status:string,results:array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>>>>>>"
    rows = lookups.select("key", text.sanitize_artist(F.col("artist")).alias("artist"), text.core_title(F.col("title")).alias("title"), _json(F.col("body"), schema).alias("j")).where("j.status = 'ok'")
    results = rows.select("key", "artist", "title", F.posexplode("j.results").alias("n", "r")).withColumn("raw", F.coalesce("r.score", F.lit(0.0)))
    alone = results.where("coalesce(r.id, '') <> '' AND raw > -1").groupBy("key").agg(F.min_by("r.id", F.struct((-F.col("raw")).alias("s"), "n")).alias("only"))
    found = results.select("key", "artist", "title", "raw", "n", F.col("r.id").alias("acoustid"), F.posexplode("r.recordings").alias("m", "rec")).where("coalesce(rec.id, '') <> ''")
    name = F.coalesce(F.get("rec.artists", 0)["name"], F.lit(""))
    found = found.withColumn("name", text.sanitize_artist(name)).withColumn("core", text.core_title(F.col("rec.title")))
    like = lambda mine, theirs, there: F.when((F.col(mine) != "") & (there != ""), similarity(mine, theirs)).otherwise(0.85)
    score = F.col("raw") * (0.35 * like("artist", "name", name) + 0.35 * like("title", "core", F.coalesce("rec.title", F.lit(""))) + 0.30 * F.col("raw"))
    best = found.withColumn("score", score).groupBy("key").agg(F.min_by(F.struct("acoustid", F.col("rec.id").alias("mbid"), "score"), F.struct((-F.col("score")).alias("s"), "n", "m")).alias("b"))
    return alone.join(best, "key", "full").select("key", F.when(F.col("b").isNotNull(), F.col("b.acoustid")).otherwise(F.col("only")).alias("acoustid"), "b.mbid", "b.score")


def recordings_by_code(answers: DataFrame) -> DataFrame:
    """(key, mbid, title): the first recording of an answer to a code."""
    rows = answers.select("key", F.get(_json(F.col("body"), "struct<recordings:array<struct<id:string,title:string>>>")["recordings"], 0).alias("r")).where("r IS NOT NULL")
    return rows.select("key", F.col("r.id").alias("mbid"), "r.title")


def recording(answers: DataFrame) -> DataFrame:
    """(key, mbid, title, seconds, isrcs, tags) of an answer to a recording's id."""
    j = _json(F.col("body"), "struct<id:string,title:string,length:double,isrcs:array<string>,tags:array<struct<name:string>>>")
    return answers.select("key", j.alias("j")).where("j.id IS NOT NULL").select("key", F.col("j.id").alias("mbid"), "j.title", (F.col("j.length") / 1000).alias("seconds"), F.coalesce("j.isrcs", F.array().cast("array<string>")).alias("isrcs"), F.coalesce("j.tags.name", F.array().cast("array<string>")).alias("tags"))


def search_hits(answers: DataFrame) -> DataFrame:
    """(key, tier, n, mbid, title, artist, seconds) of the recordings in answers (key, tier, body) to the tiers of a search."""
    schema = "struct<recordings:array<struct<id:string,title:string,length:double,`artist-credit`:array<struct<name:string,artist:struct<name:string>>>>>>"
    rows = answers.select("key", "tier", F.posexplode(_json(F.col("body"), schema)["recordings"]).alias("n", "r"))
    credit = F.get("r.artist-credit", 0)
    return rows.select("key", "tier", "n", F.col("r.id").alias("mbid"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce(_filled(credit["name"]), credit["artist"]["name"], F.lit("")).alias("artist"), (F.col("r.length") / 1000).alias("seconds"))


def search_queries(tracks: DataFrame) -> DataFrame:
    """(key, tier, query): the queries of a search for each track (key, title, artist), of which the first that finds anything counts.

    Tiers 0 to 4: the core title by the artist, the whole title by the artist (where it differs), both as terms, both anywhere, the
    core title alone. Without a known artist only the last is left, without a title none.
    """
    rows = tracks.select("key", text.query_text(text.search_title(F.col("title"))).alias("full"), text.query_text(text.core_title(F.col("title"))).alias("core"), text.query_text(text.sanitize_artist(F.col("artist"))).alias("by"))
    known = (F.col("core") != "") & (F.col("by") != "") & (F.lower("by") != "unknown artist")
    named = (F.col("full") != "") & (F.col("full") != F.col("core")) & (F.col("by") != "") & (F.lower("by") != "unknown artist")
    form = lambda pattern, *columns: F.format_string(pattern, *columns)
    tiers = F.array(
        F.when(known, form('recording:"%s" AND artist:"%s"', "core", "by")),
        F.when(named, form('recording:"%s" AND artist:"%s"', "full", "by")),
        F.when(known, form("recording:(%s) AND artist:(%s)", "core", "by")),
        F.when(known, form('"%s" AND "%s"', "core", "by")),
        F.when(F.col("core") != "", form('recording:"%s"', "core")),
    )
    return rows.select("key", F.posexplode(tiers).alias("tier", "query")).where("query IS NOT NULL")


def best_hits(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, tier, mbid, score): for each track (key, title, artist, seconds) the best hit of the first tier that has one.

    Half the title's likeness and half the artist's, both 0.40 at least; more than 15 s apart costs 0.10, more than 60 s rules out.
    """
    from tessera.functions.exact import similarity

    mine = tracks.select("key", text.search_title(F.col("title")).alias("full"), text.core_title(F.col("title")).alias("core"), text.sanitize_artist(F.col("artist")).alias("by"), F.col("seconds").alias("mine"))
    gap = F.abs(F.col("mine") - F.col("seconds"))
    timed = (F.coalesce("mine", F.lit(0.0)) > 0) & (F.coalesce("seconds", F.lit(0.0)) > 0)
    # Neither side is small because its files are: answers grow when they are read, so both are cut by their key.
    rows = hits.withColumn("their", text.sanitize_artist(F.col("artist"))).join(mine.hint("merge"), "key").where(~timed | (gap <= 60))
    rows = rows.withColumn("t", F.greatest(similarity("full", "title"), similarity("core", "title"))).withColumn("a", F.when(F.col("by") != "", similarity("by", "their")).otherwise(0.85))
    score = 0.50 * F.col("t") + 0.50 * F.col("a") - F.when(timed & (gap > 15), 0.10).otherwise(0.0)
    best = rows.where("t >= 0.40 AND a >= 0.40").withColumn("score", score).groupBy("key").agg(F.min_by(F.struct("tier", "mbid", "score"), F.struct("tier", (-F.col("score")).alias("s"), "n")).alias("b"))
    return best.select("key", "b.*")


def release_groups(answers: DataFrame) -> DataFrame:
    """(key, mbid, first_release_date): the first release group of a search's answer."""
    rows = answers.select("key", F.get(_json(F.col("body"), "struct<`release-groups`:array<struct<id:string,`first-release-date`:string>>>")["release-groups"], 0).alias("g")).where("g IS NOT NULL")
    return rows.select("key", F.col("g.id").alias("mbid"), F.col("g.first-release-date").alias("first_release_date"))


def tracklists(answers: DataFrame) -> DataFrame:
    """(key, disc, position, title, mbid, isrc) of the tracks in a release's answer, media after media; a track without title takes its recording's."""
    schema = "struct<media:array<struct<tracks:array<struct<position:int,title:string,recording:struct<id:string,title:string,isrcs:array<string>>>>>>>"
    media = answers.select("key", F.posexplode(_json(F.col("body"), schema)["media"]).alias("disc", "m")).select("key", (F.col("disc") + 1).alias("disc"), F.explode("m.tracks").alias("x"))
    return media.select("key", "disc", "x.position", F.coalesce(_filled(F.col("x.title")), F.col("x.recording.title")).alias("title"), F.col("x.recording.id").alias("mbid"), F.get("x.recording.isrcs", 0).alias("isrc"))


_TAGS = "tags:array<struct<name:string>>"


def _names(tags: Column) -> Column:
    return F.filter(F.coalesce(tags["name"], F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def group_releases(answers: DataFrame) -> DataFrame:
    """(key, release, first_release_date, tags): the first release of a group's answer; a group without one has no row."""
    j = _json(F.col("body"), f"struct<`first-release-date`:string,{_TAGS},releases:array<struct<id:string>>>")
    rows = answers.select("key", j.alias("j")).select("key", _filled(F.get("j.releases", 0)["id"]).alias("release"), F.col("j.first-release-date").alias("first_release_date"), _names(F.col("j.tags")).alias("tags"))
    return rows.where("release IS NOT NULL")


def release_details(groups: DataFrame, releases: DataFrame) -> DataFrame:
    """(key, first_release_date, tags, tracks) of groups' answers (key, body) by their first release, releases: answers (key, body) by its id.

    tags: those of the group and of the release, each once, in order; tracks: (position, title, mbid, isrc), media after
    media. A group whose release has no answer has no row; one without media has no tracks.
    """
    schema = f"struct<{_TAGS},media:array<struct<tracks:array<struct<position:int,title:string,recording:struct<id:string,title:string,isrcs:array<string>>>>>>>"
    track = lambda x: F.struct(x["position"].alias("position"), F.coalesce(_filled(x["title"]), x["recording"]["title"]).alias("title"), x["recording"]["id"].alias("mbid"), F.get(x["recording"]["isrcs"], 0).alias("isrc"))
    none = F.array().cast("array<struct<position:int,title:string,mbid:string,isrc:string>>")
    listed = F.flatten(F.transform(F.coalesce("j.media", F.array().cast("array<struct<tracks:array<struct<position:int,title:string,recording:struct<id:string,title:string,isrcs:array<string>>>>>>")), lambda m: F.coalesce(F.transform(m["tracks"], track), none)))
    details = releases.select(F.col("key").alias("release"), _json(F.col("body"), schema).alias("j")).where("j IS NOT NULL").select("release", _names(F.col("j.tags")).alias("more"), listed.alias("tracks"))
    found = group_releases(groups).join(details.hint("merge"), "release")  # both grow with the answers, neither is small
    return found.select("key", "first_release_date", F.array_sort(F.array_distinct(F.concat("tags", "more"))).alias("tags"), "tracks")


def artist_facts(answers: DataFrame) -> DataFrame:
    """(key, qid, country, gender, artist_type, formed_year): the first binding of an answer, null throughout where there is none (known to be unknown)."""
    value = "struct<value:string>"
    schema = f"struct<results:struct<bindings:array<struct<wikidataQID:{value},countryCode:{value},inception:{value},genderLabel:{value},artistTypeLabel:{value}>>>>"
    b = F.get(_json(F.col("body"), schema)["results"]["bindings"], 0)
    year = F.regexp_extract(F.coalesce(b["inception"]["value"], F.lit("")), "^([0-9]{4})", 1)
    return answers.select("key", b["wikidataQID"]["value"].alias("qid"), b["countryCode"]["value"].alias("country"), b["genderLabel"]["value"].alias("gender"), b["artistTypeLabel"]["value"].alias("artist_type"), year.try_cast("int").alias("formed_year"))


def track_codes(answers: DataFrame) -> DataFrame:
    """(key, isrc): the first hit's code where it has twelve characters."""
    code = F.get(_json(F.col("body"), "struct<data:array<struct<isrc:string>>>")["data"], 0)["isrc"]
    return answers.select("key", F.upper(code).alias("isrc")).where("length(isrc) = 12")


def store_tracks(answers: DataFrame) -> DataFrame:
    """(key, album, genre, release_date): the first hit of a store search, the date without its time."""
    r = F.get(_json(F.col("body"), "struct<results:array<struct<collectionName:string,primaryGenreName:string,releaseDate:string>>>")["results"], 0)
    rows = answers.select("key", r.alias("r")).where("r IS NOT NULL")
    return rows.select("key", F.col("r.collectionName").alias("album"), F.col("r.primaryGenreName").alias("genre"), F.substring(_filled(F.col("r.releaseDate")), 1, 10).alias("release_date"))


def release_search(answers: DataFrame) -> DataFrame:
    """(key, catno, barcode, styles): the first hit of a release search; styles go before genres."""
    r = F.get(_json(F.col("body"), "struct<results:array<struct<catno:string,barcode:array<string>,style:array<string>,genre:array<string>>>>")["results"], 0)
    none = F.array().cast("array<string>")
    rows = answers.select("key", r.alias("r")).where("r IS NOT NULL")
    return rows.select("key", "r.catno", F.trim(F.get("r.barcode", 0)).alias("barcode"), F.concat(F.coalesce("r.style", none), F.coalesce("r.genre", none)).alias("styles"))


def top_tags(answers: DataFrame, most: int = 8) -> DataFrame:
    """(key, n, tag, weight): the first eight tags of a track that have a name; a count that isn't a number is 50."""
    tags = F.slice(_json(F.col("body"), "struct<toptags:struct<tag:array<struct<name:string,count:string>>>>")["toptags"]["tag"], 1, most)
    rows = answers.select("key", F.posexplode(tags).alias("n", "x")).where("coalesce(x.name, '') <> ''")
    return rows.select("key", "n", F.col("x.name").alias("tag"), F.coalesce(F.col("x.count").try_cast("double"), F.lit(50.0)).alias("weight"))


_CANDIDATE = ["key", "title", "artist_name", "mbid", "genre"]


def discography(answers: DataFrame) -> DataFrame:
    """Candidates (key, title, artist_name, mbid, genre) from an artist's (key, entity_name, body) release groups; the key is an identifier of 36 characters."""
    schema = "struct<`release-groups`:array<struct<id:string,title:string>>>"
    rows = answers.where("length(key) = 36").select("key", F.col("entity_name").alias("artist_name"), F.explode(_json(F.col("body"), schema)["release-groups"]).alias("g"))
    return rows.where("coalesce(g.title, '') <> '' AND coalesce(g.id, '') <> ''").select("key", "g.title", "artist_name", F.col("g.id").alias("mbid"), F.lit("Discography").alias("genre"))


def genre_network(answers: DataFrame, most: int = 40) -> DataFrame:
    """Candidates from releases of artists that share a genre, the first forty of an answer."""
    value = "struct<value:string>"
    schema = f"struct<results:struct<bindings:array<struct<releaseGroup:{value},title:{value},similarArtistLabel:{value},genreLabel:{value}>>>>"
    rows = answers.select("key", F.explode(F.slice(_json(F.col("body"), schema)["results"]["bindings"], 1, most)).alias("b"))
    link = F.coalesce("b.releaseGroup.value", F.lit(""))
    out = rows.select("key", F.col("b.title.value").alias("title"), F.col("b.similarArtistLabel.value").alias("artist_name"), F.when(F.contains(link, F.lit("/")), F.element_at(F.split(link, "/"), -1)).alias("mbid"), F.coalesce("b.genreLabel.value", F.lit("Unclassified")).alias("genre"))
    return out.where("coalesce(title, '') <> '' AND coalesce(artist_name, '') <> ''")


def similar_artists(answers: DataFrame, most: int = 3) -> DataFrame:
    """(key, n, name): the first three similar artists of an answer, those with a name."""
    artists = F.slice(_json(F.col("body"), "struct<similarartists:struct<artist:array<struct<name:string>>>>")["similarartists"]["artist"], 1, most)
    return answers.select("key", F.posexplode(artists).alias("n", "a")).where("coalesce(a.name, '') <> ''").select("key", "n", "a.name")


def similar_albums(similar: DataFrame, albums: DataFrame, most: int = 4) -> DataFrame:
    """Candidates from the first four albums of similar artists (key, name), albums: answers (name, body)."""
    found = F.slice(_json(F.col("body"), "struct<topalbums:struct<album:array<struct<name:string,mbid:string>>>>")["topalbums"]["album"], 1, most)
    rows = similar.join(albums.select("name", F.explode(found).alias("b")), "name").where("coalesce(b.name, '') <> '' AND lower(b.name) <> '(null)'")
    return rows.select("key", F.col("b.name").alias("title"), F.col("name").alias("artist_name"), F.when(F.length("b.mbid") == 36, F.col("b.mbid")).alias("mbid"), F.lit("Similar").alias("genre"))


def artist_ids(answers: DataFrame) -> DataFrame:
    """(key, mbid): the first artist of a search by name."""
    return answers.select("key", F.get(_json(F.col("body"), "struct<artists:array<struct<id:string>>>")["artists"], 0)["id"].alias("mbid")).where("coalesce(mbid, '') <> ''")


def genre_seeds(answers: DataFrame, most: int = 15) -> DataFrame:
    """(seed_id, entity_name): artists of a genre, the first fifteen of an answer, each once."""
    value = "struct<value:string>"
    found = F.slice(_json(F.col("body"), f"struct<results:struct<bindings:array<struct<artistMBID:{value},artistLabel:{value}>>>>")["results"]["bindings"], 1, most)
    rows = answers.select(F.explode(found).alias("b")).select(F.col("b.artistMBID.value").alias("seed_id"), F.col("b.artistLabel.value").alias("entity_name"))
    return rows.where("coalesce(seed_id, '') <> '' AND coalesce(entity_name, '') <> ''").groupBy("seed_id").agg(F.min("entity_name").alias("entity_name"))
