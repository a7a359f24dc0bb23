"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from farelake.session import delete_folders, shared_folder


class _Rounds:
    """Edge tables in the shared folder; those that no round needs any more are deleted."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def store(self, edges: DataFrame) -> DataFrame:
        self.paths.append(shared_folder(self.spark))
        edges.write.parquet(self.paths[-1])
        return self.spark.read.schema(edges.schema).parquet(self.paths[-1])

    def keep_last(self):
        for path in self.paths[:-1]:
            delete_folders(self.spark, path)
        del self.paths[:-1]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), long integers; ``root`` is the smallest node of the component.

    Each round is stored in the shared folder, and deleted when the next one is. A round links every node to its smallest
    neighbour, by aggregates that combine before their shuffle; edges and components stay distributed, and only a row
    count and a checksum reach the driver.
    """
    rounds = _Rounds(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = rounds.store(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = rounds.store(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = rounds.store(small.union(least).distinct())
        rounds.keep_last()
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
