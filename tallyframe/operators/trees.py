"""Trees of parent links, by pointer doubling: each round looks twice as far up, so depth d takes about log2(d) of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import held


def _rounds(nodes: DataFrame) -> int:
    """Rounds after which every chain without a cycle has ended."""
    return nodes.count().bit_length() + 1


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, name, parent_id, path (names from the root, by /), depth (root: 0), root (name), of rows id, name, parent_id.

    Nodes whose chain ends at an id that isn't there, or never, have no path and no row.
    """
    # up: the node that what is known of the path begins below; null once that is a root's path.
    rows = held(nodes.select("id", "name", "parent_id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(0).alias("depth"), F.col("name").alias("root")))
    done, left = rows.filter("up IS NULL"), rows.filter("up IS NOT NULL")
    for _ in range(_rounds(nodes)):
        if left.isEmpty():
            break
        above = done.unionByName(left).select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        moved = left.join(above, "up").select(
            "id", "name", "parent_id", F.col("far").alias("up"), F.concat("_path", F.lit("/"), "path").alias("path"), (F.col("depth") + F.col("_depth") + 1).alias("depth"), F.col("_root").alias("root")
        )
        moved = held(moved)
        done, left = done.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    return done.drop("up")


def tree_closure(nodes: DataFrame) -> DataFrame:
    """category_id, ancestor_id of every node and itself and each node above it; ValueError for a cycle."""
    jump = held(nodes.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")))
    # Before round k: pairs nearer than 2^k, and jumps over 2^k.
    found = None
    for _ in range(_rounds(nodes)):
        if jump.isEmpty():
            break
        far = lambda pairs: jump.join(pairs.toDF("up", "far"), "up").select("id", F.col("far").alias("up"))
        found = jump if found is None else held(found.union(jump).union(far(found)))
        jump = held(far(jump))
    else:
        if not jump.isEmpty():
            raise ValueError("the tree has a cycle")
    own = nodes.select(F.col("id").alias("category_id"), F.col("id").alias("ancestor_id"))
    return own if found is None else own.union(found)
