"""Connected components of large graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share (spark.checkpoint.dir), and read back."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # one machine, as in tests
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() wrote, once all that reads them has been written itself."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node of the component.

    Every node hooks on to its least neighbour and the hooked graph is contracted until no edge is left; each round
    reads what the one before has written, so a lost executor repeats one round only.
    """
    roots, left, turn = None, written(edges.select("a", "b").where("a <> b").distinct(), "edges"), 0
    while roots is None or not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("u", "v")
        if turn % 2 == 0:
            least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        else:  # another order now and then, so that long ordered paths shrink too
            mixed = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c).alias("k"))  # noqa: B023, E731
            least = both.groupBy("u").agg(F.min_by("v", mixed("v")).alias("v")).select("u", F.when(mixed("v") < mixed("u"), F.col("v")).otherwise(F.col("u")).alias("to"))
        hooks = written(least, "hooks")
        if roots is None:
            roots = hooks.toDF("node", "label")
        else:
            before, roots = roots, written(roots.join(hooks, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            discard(before)
        met = left
        for end in ("a", "b"):
            met = met.join(hooks.toDF(end, f"to_{end}"), end)
        before, left = left, written(met.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        discard(before, *([hooks] if turn else []))  # the first hooks are the first labels
        turn += 1
    least = roots.groupBy("label").agg(F.min("node").alias("root"))
    return roots.join(least, "label").select("node", "root")
