"""Connected components of links between ids, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.session import scratch_dir


def delete(spark, path):
    """Remove a folder of intermediate results."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _large_star(edges):
    """Every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges):
    """A node and its smaller neighbours to the smallest of them. Edges go from larger to
    smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    other = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b) that has a smaller one in its
    component, the smallest there. Links to itself and null ends do not count.

    Each round is two joins and aggregations on narrow rows, written to the shared folder, so
    lineage stays short; the number of rounds grows with the logarithm of the longest chain.
    It ends when every node has one edge and no edge ends at a node that has one.
    """
    spark = links.sparkSession
    edges = links.dropna().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    path = scratch_dir(spark, "edges")
    edges.write.parquet(path)
    while True:
        edges = spark.read.schema("u long, v long").parquet(path)
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        following = scratch_dir(spark, "edges")
        _small_star(_large_star(edges)).write.parquet(following)
        delete(spark, path)
        path = following


def _settled(edges):
    """Whether the edges are stars around the smallest node of each component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("ends")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("ends")))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("ends").alias("ends"))
    return degrees.filter("out > 1 or (out = 1 and ends = 1)").isEmpty()
