"""A parsed file gives all its rows at once, and the files' bytes are those of their SQL."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.plans import upkeep
from tessera.sources import media
from tessera.sources.fixtures import Catalog, with_tables


def test_parsed_files_are_read_three_times(spark, small):
    plan = upkeep.fan_out(Catalog(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3 and plan.count("Python") + plan.count("ArrowEval") <= 2


def test_bytes_are_those_of_the_sql(spark, small):
    t = Catalog(spark, small)
    ours = t.media_files.select("path", "kind", "content")
    sql = t._of(with_tables("SELECT path, kind, content AS wanted FROM media_files"))
    found = ours.join(sql, ["path", "kind"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("content") == F.col("wanted")).cast("int")).alias("same")).collect()
    assert len(found) == 5 and all(r.n == r.same for r in found) and sum(r.n for r in found) == ours.count() == sql.count()


def test_odd_files_give_their_facts(rows):
    tagged = [("a/01 - One.mp3", {"genre": "Rock;; É-x", "title": "  ", "artist": " Can "}), ("b/disc 2/Two.flac", {"subgenre": " IDM "}), ("c.ogg", {}), ("d.ogg", None), ("e/ ", {"genre": ";", "isrc": "X"})]
    parsed = rows([(path, "SUCCESS", f"m{k}", tags, f"p{k}") for k, (path, tags) in enumerate(tagged)] + [("f.mp3", "CORRUPTED", None, None, None)], "path string, status string, md5_file string, tags map<string,string>, payload_hash string")
    for column in media.PARSED.split(", "):
        name, kind = column.split(" ")
        parsed = parsed if name in parsed.columns else parsed.withColumn(name, F.lit(None).cast(kind))
    got = {(r.payload_hash, r.field_name, r.value, r.source_id, r.evidence_class, r.confidence, r.token_index) for r in media.fan_out(parsed)["evidence"].collect()}
    own = lambda k, field, value, weight=1.0, index=0: (f"p{k}", field, value, "SRC_EMBEDDED_TAGS", "LOCAL", weight, index)
    seed = lambda k, field, value: (f"p{k}", field, value, "SRC_PATH_SEED", "LOCAL", 1.0, 0)
    assert {g for g in got if g[4] == "LOCAL"} == {own(0, "artist", "Can"), own(0, "genre", "rock"), own(0, "genre", "e x", 0.75, 1), own(1, "subgenre", "idm"), own(4, "isrc", "X"), *[seed(k, "title", x) for k, x in ((0, "One"), (1, "Two"), (2, "c"), (3, "d"))], *[seed(k, "disc_number", x) for k, x in ((0, "1"), (1, "2"), (2, "1"), (3, "1"), (4, "1"))]}
    assert {g[:3] for g in got if g[4] == "DERIVED"} == {("p0", "genre", "Rock"), ("p0", "subgenre", "E X"), ("p1", "genre", "Idm"), ("p1", "subgenre", "Alternative Rock")}


def test_aliases_of_lists():
    lists = pa.array([["q"], ["A-b", None], None, [], [" É x"]], pa.list_(pa.string()))
    assert exact.tag_aliases.func(lists.slice(1)).to_pylist() == [["a b", ""], None, [], ["e x"]]
