"""Groups of records that pairs link directly or over others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.runtime import land, release

#: A vertex with more than this share of all edge ends is hot; there are at most its reciprocal many.
HOT_SHARE = 1 / 1000


def _push(ends: DataFrame, hot: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest label that reaches each vertex over its edges: (v, label).

    Labels of the hot vertices, at most 1 / HOT_SHARE rows, are broadcast to their edges, which so stay where they are; the others
    join by shuffle. The minimum is taken per task before it moves.
    """
    hot_labels = F.broadcast(labels.join(F.broadcast(hot), "v", "left_semi"))
    near = ends.filter("hot").join(hot_labels.withColumnRenamed("v", "u"), "u")
    far = ends.filter(~F.col("hot")).join(labels.withColumnRenamed("v", "u"), "u")
    return near.select("v", "label").unionByName(far.select("v", "label")).groupBy("v").agg(F.min("label").alias("label"))


def _jump(labels: DataFrame, vertices: int) -> tuple[DataFrame, DataFrame]:
    """Labels after each vertex took the label of the vertex that its label names, (v, label), and the landed table that this reads.

    The labels in use are looked up once each. Those of more than HOT_SHARE of the vertices, at most its reciprocal many, are broadcast, so
    the vertices of a giant group stay where they are; those of the others join by shuffle.
    """
    used = labels.groupBy(F.col("label").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    jump = land(used.join(labels, "v").select(F.col("v").alias("label"), F.col("label").alias("next"), (F.col("n") > max(1000, int(vertices * HOT_SHARE))).alias("hot")), "jump")
    hot = F.broadcast(jump.filter("hot").select("label", "next"))
    near = labels.join(hot, "label").select("v", F.col("next").alias("label"))
    rest = labels.join(hot.select("label"), "label", "left_anti")
    far = rest.join(jump.filter("not hot and label <> next").select("label", "next"), "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    return near.unionByName(far), jump


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(v, label) for every end of a pair: the smallest member of its group, the same for all of a group.

    Each round propagates minimum labels across the edges, to a vertex and to the vertex that its label names, and then jumps: a vertex
    takes the label of the vertex its label names. The rounds needed grow as the logarithm of the longest chain.
    Rounds end when no label changes; each is written to the shared folder, so lineage stays short and a lost executor costs one
    round. Pairs repeat or mirror freely; a pair of one vertex with itself is a group of its own if nothing else links it; pairs with
    a null end are left out. Labels compare in the order of their type (strings in byte order). An empty input gives no rows.
    """
    given = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    ends = given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = land(ends, "ends")
    vertices = ends.select("u").union(ends.select("v")).distinct().toDF("v")
    both = ends.filter("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    total = both.agg(F.count(F.lit(1)).alias("t")).scalar()
    hot = land(degree.filter(F.col("d") > F.greatest(F.lit(1000), total * HOT_SHARE)).select(F.col("u").alias("v")), "hot")
    both = land(both.join(F.broadcast(hot.select(F.col("v").alias("u"), F.lit(True).alias("hot"))), "u", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "both")
    labels = land(vertices.withColumn("label", F.col("v")), "labels")
    vertex_count = labels.count()
    for _ in range(max_rounds):  # far more than any logarithm
        # the smallest label next to a vertex goes to the vertex and to the one its label names, which hooks whole groups onto each other
        near = labels.join(_push(both, hot, labels).withColumnRenamed("label", "best"), "v").select(F.explode(F.array("v", "label")).alias("v"), F.col("best").alias("label"))
        reached = land(labels.unionByName(near).groupBy("v").agg(F.min("label").alias("label")), "reached")
        jumped, jump = _jump(reached, vertex_count)
        jumped = land(jumped, "labels")
        same = labels.withColumnRenamed("label", "old").join(jumped, "v").filter("old <> label").isEmpty()
        release(reached, jump, labels)
        labels = jumped
        if same:
            release(ends, hot, both)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
