"""Audio files as rows: hashes, audio properties, embedded tags, path seeds, and the facts that follow from them."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exact, fixed, text
from tessera.sources.audio import Sound, mp4_atoms, ogg_packets, sound_of

SKIPPED, LONGEST = 8192, 2000
#: Quality of a recording that only its file tells of.
START_QUALITY = 0.2
PARSED = "path string, status string, md5_file string, sha256_file string, audio_stream_hash string, duration double, format string, bitrate int, sample_rate int, channels int, file_size long, tags map<string,string>, payload binary, payload_hash string"
_EMPTY = ("NONE", "NULL", "UNKNOWN")


def id3_tags(data: bytes) -> dict[str, list[str]]:
    """Text frames of an ID3v2.3 or 2.4 header by frame name, those of users as TXXX:description."""
    found: dict[str, list[str]] = {}
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (3, 4):
        return found
    safe = lambda b: (b[0] << 21) | (b[1] << 14) | (b[2] << 7) | b[3]
    at, end = 10, min(len(data), 10 + safe(data[6:10]))
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = safe(raw) if data[3] == 4 else struct.unpack(">I", raw)[0]
        body, at = data[at + 10 : at + 10 + size], at + 10 + size
        if name[0] != "T" or not body:
            continue
        codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
        parts = [p for p in body[1:].decode(codec, "replace").replace("﻿", "").split("\0")]
        if name == "TXXX":
            name, parts = f"TXXX:{parts[0].upper()}", parts[1:]
        found.setdefault(name, []).extend(p.strip() for p in parts if p.strip())
    return found


def vorbis_tags(data: bytes) -> dict[str, list[str]]:
    """Comments of a FLAC or Ogg file by upper-cased name."""
    found: dict[str, list[str]] = {}
    block = b""
    if data[:4] == b"fLaC":
        at = 4
        while at + 4 <= len(data):
            kind, size = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            if kind == 4:
                block = data[at + 4 : at + 4 + size]
            if data[at] & 128:
                break
            at += 4 + size
    elif data[:4] == b"OggS":
        packet = next((p for k, (p, _) in enumerate(ogg_packets(data)) if k == 1), b"")
        block = next((packet[len(mark) :] for mark in (b"\x03vorbis", b"OpusTags") if packet.startswith(mark)), b"")
    word = lambda at: struct.unpack_from("<I", block, at)[0]
    try:
        at = 4 + word(0)
        for _ in range(word(at)):
            at += 4
            size = word(at)
            name, _, value = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            at += size
            if value.strip():
                found.setdefault(name.upper(), []).append(value.strip())
    except struct.error:
        pass
    return found


def mp4_tags(data: bytes) -> dict[str, list[str]]:
    """Texts and numbers in the list of items of an MP4 file by name, without pictures."""
    found: dict[str, list[str]] = {}
    for path, a, b in mp4_atoms(data):
        if path[-1] != b"data" or path[-3:-2] != (b"ilst",) or b - a < 8:
            continue
        kind, body = int.from_bytes(data[a + 1 : a + 4], "big"), data[a + 8 : b]
        name = path[-2].decode("latin-1")
        if kind == 1:
            found.setdefault(name, []).append(body.decode("utf-8", "replace"))
        elif path[-2] in (b"trkn", b"disk") and len(body) >= 6:
            found.setdefault(name, []).append("/".join(str(int.from_bytes(body[k : k + 2], "big")) for k in (2, 4)))
        elif kind == 21:
            found.setdefault(name, []).append(str(int.from_bytes(body, "big", signed=True)))
    return found


#: The field of each tag, first found first, for files with comments and for files with frames; MP4 items make no fields.
_COMMENTS = {"title": ["TITLE"], "artist": ["ARTIST"], "album": ["ALBUM"], "release_date": ["DATE", "YEAR"], "isrc": ["ISRC"], "genre": ["GENRE"], "subgenre": ["SUBGENRE"], "track_number": ["TRACKNUMBER"], "musicbrainz_recording_id": ["MUSICBRAINZ_TRACKID"]}
_FRAMES = {"title": ["TIT2"], "artist": ["TPE1"], "album": ["TALB"], "release_date": ["TDRC", "TYER"], "isrc": ["TSRC"], "genre": ["TCON"], "subgenre": ["TXXX:SUBGENRE"], "track_number": ["TRCK"], "musicbrainz_recording_id": ["TXXX:MUSICBRAINZ_TRACKID"]}


def tags_of(data: bytes, suffix: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Fields with a value, several joined by " ; ", and all tags as they are."""
    if suffix == "mp3":
        raw, wanted = id3_tags(data), _FRAMES
    elif suffix in ("flac", "ogg"):
        raw, wanted = vorbis_tags(data), _COMMENTS
    else:
        raw, wanted = mp4_tags(data) if suffix == "m4a" else {}, {}
    joined = {}
    for field, names in wanted.items() if raw else ():
        for name in names:
            if raw.get(name) and (value := " ; ".join(raw[name])).upper() not in _EMPTY:
                joined[field] = value
                break
    return {k: v for k, v in joined.items() if v}, raw


def audio_of(data: bytes) -> Sound:
    """The file's sound; where it can't be read, the hash of what follows the first 8 KiB and the least that is assumed of any file."""
    try:
        return sound_of(data)
    except ValueError:
        return Sound(hashlib.md5(data[min(len(data), SKIPPED) :]).hexdigest(), 0.0, 44_100, 2, 0)


def parse_media(files: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Rows of PARSED from files (path, content); a file without content is CORRUPTED and has nothing else.

    Columns named in ``skipped`` are null; their work is left out.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [pa.field(name, kinds[kind]) for name, kind in (c.split(" ") for c in PARSED.split(", "))]
    tagged, encode = not {"tags", "payload", "payload_hash"} <= {*skipped}, json.JSONEncoder(sort_keys=True).encode

    def row(path: str, data: bytes | None) -> dict:
        if not data:
            return {"path": path, "status": "CORRUPTED"}
        suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        sound = audio_of(data)
        out = {"path": path, "status": "SUCCESS", "audio_stream_hash": sound.stream, "duration": sound.seconds, "format": suffix.upper() or "MP3", "bitrate": sound.bitrate, "sample_rate": sound.rate, "channels": sound.channels, "file_size": len(data)}
        if "md5_file" not in skipped:
            out["md5_file"] = hashlib.md5(data).hexdigest()
        if "sha256_file" not in skipped:
            out["sha256_file"] = hashlib.sha256(data).hexdigest()
        if tagged:
            tags, raw = tags_of(data, suffix)
            out["tags"] = list(tags.items())
            dump = encode(raw).encode() if raw else b"{}"
            if "payload" not in skipped:
                out["payload"] = gzip.compress(dump, mtime=0)
            if "payload_hash" not in skipped:
                out["payload_hash"] = hashlib.sha256(dump).hexdigest()
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(path, data) for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) if f.name in skipped else pa.array([r.get(f.name) for r in rows], f.type) for f in fields], schema=pa.schema(fields))

    return files.select("path", "content").mapInArrow(work, PARSED)


def good_files(parsed: DataFrame) -> DataFrame:
    """Parsed files that could be read, with asset_id and recording_id, which follow from the file's hash and path."""
    made = lambda kind: F.md5(F.concat(F.lit(kind), "md5_file", "path").cast("binary"))
    return parsed.where("status = 'SUCCESS'").withColumn("asset_id", made("asset")).withColumn("recording_id", made("recording"))


def _fact(field: Column, value: Column, raw: Column, source: str, kind: str = "LOCAL", weight: Column | None = None, confidence: Column | None = None, index: Column | None = None) -> Column:
    one = F.lit(1.0)
    weight = one if weight is None else weight
    return F.struct(field.alias("field_name"), value.alias("value"), F.lit(kind).alias("evidence_class"), F.lit(source).alias("source_id"), (weight if confidence is None else confidence).alias("confidence"), raw.alias("raw_value"), (F.lit(0) if index is None else index).alias("token_index"), weight.alias("positional_weight"))


def plain_facts() -> Column:
    """The facts of a parsed file's tags but lists, and of its path: array of (field_name, value, evidence_class, source_id, confidence, raw_value, token_index, positional_weight)."""
    raw = lambda e: F.substring(F.trim(e["value"]), 1, LONGEST)
    tags = F.transform(F.filter(F.map_entries("tags"), lambda e: (F.trim(e["value"]) != "") & ~e["key"].isin(*_LISTED)), lambda e: _fact(e["key"], raw(e), raw(e), "SRC_EMBEDDED_TAGS"))
    seeds = F.array(*[F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in (("title", text.path_seed(F.col("path"))), ("disc_number", text.disc_number(F.col("path")).cast("string")))])
    seeded = F.transform(F.filter(seeds, lambda e: e["value"] != ""), lambda e: _fact(e["key"], e["value"], e["value"], "SRC_PATH_SEED"))
    return F.concat(F.coalesce(tags, F.filter(seeded, lambda e: F.lit(False))), seeded)


def genre_facts(good: DataFrame) -> DataFrame:
    """(recording_id, payload_hash, facts) of good files with a genre or subgenre; facts like those of plain_facts.

    A genre is cut at its delimiters; each further part weighs 0.75 of the one before. What the parts agree on is derived.
    """
    from tessera.operators.taxonomy import row_consensus

    # A recording's tags are those of its file, so they lie in one row.
    tag = lambda p: F.struct(F.concat(p["field_name"], F.format_string("%05d", p["token_index"])).alias("seq"), p["value"].alias("tag"), p["weight"].alias("weight"), F.lit("SRC_EMBEDDED_TAGS").alias("source"))
    parts = genre_parts(good).select("recording_id", "payload_hash", F.element_at("tags", "artist").alias("artist"), F.filter("parts", lambda p: p["value"] != "").alias("parts"))
    agreed = row_consensus(parts.withColumn("listed", F.transform("parts", tag)))
    said = lambda c: F.when((F.col("genre") != "Unclassified") & (F.size("parts") > 0), F.col(c))
    derived = F.filter(F.array(*[_fact(F.lit(c), said(c), said(c), "SRC_TAXONOMY", "DERIVED", confidence=F.col("confidence")) for c in _LISTED]), lambda f: f["value"] != "")
    own = F.transform("parts", lambda p: _fact(p["field_name"], p["value"], p["raw_value"], "SRC_EMBEDDED_TAGS", weight=p["weight"], index=p["token_index"]))
    return agreed.select("recording_id", "payload_hash", F.concat(own, derived).alias("facts"))


#: Fields whose tags are lists.
_LISTED = ("genre", "subgenre")


def genre_parts(parsed: DataFrame) -> DataFrame:
    """Parsed files with a genre or subgenre, and their parts: array of (field_name, token_index, value, raw_value, weight)."""
    raw = {f: F.trim(F.element_at("tags", f)) for f in _LISTED}
    rows = parsed.where(F.greatest(*[F.coalesce(F.length(x), F.lit(0)) for x in raw.values()]) > 0)
    cuts = {f"__{f}": F.when(x != "", F.split(F.substring(x, 1, LONGEST), fixed.TAG_DELIMITERS)) for f, x in raw.items()}
    rows = rows.withColumns(cuts).withColumns({f"__{f}_values": exact.tag_aliases(f"__{f}") for f in _LISTED})
    part = lambda f: lambda x, k: F.struct(F.lit(f).alias("field_name"), k.alias("token_index"), F.get(f"__{f}_values", k).alias("value"), F.trim(x).alias("raw_value"), F.round(F.pow(F.lit(0.75), k), 4).alias("weight"))
    parts = F.concat(*[F.coalesce(F.transform(f"__{f}", part(f)), F.array().cast(_PARTS)) for f in _LISTED])
    return rows.withColumn("parts", parts).select(*parsed.columns, "parts")


_PARTS = "array<struct<field_name:string,token_index:int,value:string,raw_value:string,weight:double>>"


def fan_out(parsed: DataFrame) -> dict[str, DataFrame]:
    """Rows of six tables from parsed files, the good ones: recordings, assets, locations, evidence, validation and payloads.

    Ids follow from the file's hash. Genres of the tags add derived facts of the consensus. A recording starts with its file
    name as title, PARSED and of quality 0.20.
    """
    good = good_files(parsed)
    facts = lambda rows, found: rows.select("recording_id", "payload_hash", F.inline(found))
    columns = ["recording_id", "field_name", "value", "evidence_class", "source_id", "payload_hash", "confidence", "raw_value", "token_index", "positional_weight"]
    return {
        "recordings": good.select(F.col("recording_id").alias("id"), F.element_at(F.split("path", "/"), -1).alias("title"), F.lit("PARSED").alias("state")),
        "assets": good.select("asset_id", "recording_id", "md5_file", "sha256_file", "audio_stream_hash", "duration", "format", "bitrate", "sample_rate", "channels", "file_size"),
        "locations": good.select("asset_id", F.col("path").alias("filepath"), F.lit(1).alias("is_available")),
        "evidence": facts(good, plain_facts()).unionByName(facts(genre_facts(good), "facts")).select(*columns).withColumnRenamed("recording_id", "entity_id"),
        "validation": good.select("recording_id", F.lit(START_QUALITY).alias("quality_score")),
        "payloads": good.select(F.col("payload_hash").alias("content_hash"), "payload").dropDuplicates(["content_hash"]),
    }
