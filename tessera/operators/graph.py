"""Connected components by hooking to the smallest neighbour and jumping pointers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in a local session, which has no other machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: smaller than a checkpoint, and read by columns."""
    folder = f"{shared_folder(frame.sparkSession)}/rows-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node.

    A round takes each node's smallest label among its neighbours, hooks the label's own node to it and jumps to
    the label's label; rounds grow with the logarithm of the longest path.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("m"))
        hooks = low.groupBy("label").agg(F.min("m").alias("hook")).select(F.col("label").alias("root"), "hook")
        hooked = low.join(hooks, low.node == hooks.root, "left").select("node", "label", F.least("m", F.coalesce("hook", "m")).alias("new"))
        parents = hooked.select(F.col("node").alias("p"), F.col("new").alias("jump"))
        jumped = cut(hooked.join(parents, hooked.new == parents.p, "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new")))
        changed = not jumped.where("label <> new").isEmpty()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            break
    return labels.select("node", F.col("label").alias("component")).unionByName(alone.join(labels, "node", "left_anti").distinct().select("node", F.col("node").alias("component")))
