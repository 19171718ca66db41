"""Connected components of a graph whose links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import delete, join_groups, noted, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to `key, label`: every end of a link with the least key that it is connected with.

    Each round a node goes to the one among itself and its neighbours that has most links (of equals the first by
    a hash), then to where that one went; links between the places reached are the next round's graph. What hangs
    on a hub is gone after a round, and hashes differ by round, so a long path shrinks by a constant factor on
    average: all rounds together take a multiple of the links. Places of hot nodes (of which there are few) are
    broadcast, so no task gets all of a hub's links. Each round is written, so a lost executor loses no round.
    """
    spark, graph = links.sparkSession, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    with noted() as paths:
        graph, rounds = written(graph, "links"), []
        while not graph.isEmpty():
            seed = F.lit(len(rounds))
            ends = graph.union(graph.select("b", "a"))
            degrees = written(ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "labels")
            n, n_ends, most = degrees.agg(F.count(F.lit(1)), F.sum("degree"), F.max("degree")).first()
            first = lambda c, degree: F.struct((-degree).alias("fewer"), F.xxhash64(c, seed).alias("hash"), F.col(c).alias("node"))  # noqa: B023, E731
            seen = join_groups(ends.withColumnRenamed("b", "node"), degrees, "node", "degree", n_ends, most)
            near = seen.groupBy("a").agg(F.min(first("node", F.col("degree"))).alias("least"), F.count(F.lit(1)).alias("degree"))
            near = written(near.select(F.col("a").alias("node"), F.least("least", first("a", F.col("degree")))["node"].alias("place"), "degree"), "labels")
            taken = near.groupBy("place").agg(F.count(F.lit(1)).alias("taken"))
            jump = written(near.select(F.col("node").alias("place"), F.col("place").alias("further")).join(taken, "place"), "labels")
            moved = written(join_groups(near, jump, "place", "taken", n).select("node", F.col("further").alias("place"), "degree"), "labels")
            rounds.append((moved, n))
            for old in ("a", "b"):
                graph = join_groups(graph.withColumnRenamed(old, "node"), moved, "node", "degree", n_ends, most).drop("node", "degree").withColumnRenamed("place", old)
            graph = written(graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
        labels = spark.createDataFrame([], "node long, label long")
        for moved, n in reversed(rounds):
            taken = moved.groupBy("place").agg(F.count(F.lit(1)).alias("taken"))
            further = written(taken.join(labels.withColumnRenamed("node", "place"), "place", "left").select("place", "taken", F.coalesce("label", "place").alias("label")), "labels")
            labels = written(join_groups(moved, further, "place", "taken", n).select("node", "label"), "labels")
        named = written(labels.groupBy("label").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("taken")), "labels")
        out = written(join_groups(labels, named, "label", "taken", rounds[0][1] if rounds else 0).select(F.col("node").alias("key"), F.col("least").alias("label")), "components")
        for path in paths[:-1]:
            delete(spark, path)
    return out
