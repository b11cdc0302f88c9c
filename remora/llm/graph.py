"""Connected components of an edge table, by pointer jumping over tables in the shared folder; edges come from such a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Rows of a part of the tables between rounds.
ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(k, root) for every end of an edge (a, b): root is the smallest key that its component holds.

    Each round hooks a node's root on the smallest root next to it and then jumps to the root's root,
    so that chains shorten by half. Only a count of changes reaches the driver.
    """
    # as many parts as the rows fill, rather than one for each shuffle partition
    parts = 1 + edges.count() // ROWS
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("n")).select("k", F.least("k", "n").alias("root")).coalesce(parts), "roots")
    while True:
        near = both.join(roots.select(F.col("k").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("k")).agg(F.min("near").alias("near"))
        low = roots.join(near, "k", "left").select("k", "root", F.least("root", "near").alias("low"))
        # what a root's members found is told to the root, and a root's root is taken
        told = low.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("told"))
        hooked = low.join(told, F.col("root") == F.col("r")).select("k", F.col("root").alias("old"), F.least("low", "told").alias("root"))
        up = hooked.select(F.col("k").alias("u"), F.col("root").alias("up"))
        after = written(hooked.join(up, F.col("root") == F.col("u"), "left").select("k", "old", F.least("root", F.coalesce("up", "root")).alias("root")).coalesce(parts), "roots")
        moved = after.filter("old <> root").limit(1).count()
        drop_written(roots)
        roots = after.select("k", "root")
        if not moved:
            return roots
