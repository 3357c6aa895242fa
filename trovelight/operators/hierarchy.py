"""Trees stored as (node, parent) rows: roots, depths, paths, cycles, moves of subtrees, roots of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.sources import store

#: Keys with over one SHARE-th of the rows of a lookup are broadcast, so at most SHARE rows are.
SHARE = 10_000


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right``, unique in ``key``, where a key may hold a third of ``left``; ``left`` is a written table without null keys."""
    total = left.count()
    heavy = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > total / SHARE).select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(heavy), key, "left")
    hot = marked.filter("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, "left")
    return hot.unionByName(marked.filter("_hot is null").drop("_hot").join(right, key, "left"))


def resolve(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parent, name)`` with node, parent, name, root, depth, path and state.

    State is ``rooted``, ``orphan`` (its topmost ancestor has a parent that is not there and counts as root) or ``cycle`` (parents never end: root, depth and path
    are null). Pointers jump: each round replaces a pointer by that of the node it points to, so the reach doubles and rounds grow with the logarithm of the depth.
    A round reads all nodes and writes those that aren't done; one in which none gets done shows that the rest are in or below cycles, since a node has an ancestor
    at every smaller depth. Null nodes are dropped, of a repeated node the row with the smallest (parent, name) counts, null parent first; a null name is empty.
    """
    spark = nodes.sparkSession
    name = F.coalesce("name", F.lit(""))
    base = nodes.filter("node is not null").groupBy("node").agg(F.min(F.struct("parent", name.alias("name"))).alias("r")).select("node", "r.parent", "r.name")
    base = store.written(spark, base, "nodes")
    there = base.select(F.col("node").alias("parent"), F.lit(True).alias("_there"))
    below = lookup(base.filter("parent is not null"), there, "parent")
    start = below.unionByName(base.filter("parent is null").withColumn("_there", F.lit(None).cast("boolean")))
    kind = base.schema["node"].dataType
    nothing = F.lit(None).cast(kind)
    state = F.when(F.col("parent").isNull(), "rooted").when(F.col("_there").isNull(), "orphan")
    # ``ptr`` is an ancestor at distance ``depth``; ``path`` the names from below it. Done nodes have a state and no pointer.
    first = start.select("node", F.when(state.isNull(), F.col("parent")).otherwise(nothing).alias("ptr"), F.when(state.isNotNull(), F.col("node")).otherwise(nothing).alias("root"), F.when(state.isNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("name").alias("path"), state.alias("state"))
    now = store.written(spark, first, "jump")
    done, active = now.filter("state is not null"), now.filter("state is null")
    left = active.count()
    while left:
        target = done.unionByName(active).select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("state").alias("_state"))
        found = lookup(active, target, "ptr")
        now = store.written(spark, found.select("node", F.col("_ptr").alias("ptr"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat_ws("/", "_path", "path").alias("path"), F.col("_state").alias("state")), "jump")
        before, active = left, now.filter("state is null")
        left = active.count()
        done = done.unionByName(now.filter("state is not null"))
        if left == before:
            lost = active.select("node", nothing.alias("ptr"), nothing.alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit("cycle").alias("state"))
            done, left = done.unionByName(lost), 0
    return base.join(done.select("node", "root", "depth", "path", "state"), "node")


def move(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``nodes(node, parent, name)`` after ``moves(node, target)``, all at once: the columns of ``resolve`` and ``outcome``.

    A null target moves to the top. Outcomes: ``kept`` (no move), ``moved``, ``PARENT_NOT_FOUND`` (no such target), ``FOLDER_CYCLE`` (with all moves made, the
    parents of the node never end). Refused nodes keep their parents. No new cycle comes of it: chains of accepted moves end, and refused nodes have their old
    chains up to one of those. Moves of unknown nodes are ignored, of several moves of a node the one to the smallest target counts, null first.
    """
    spark = nodes.sparkSession
    name = F.coalesce("name", F.lit(""))
    rows = nodes.filter("node is not null").groupBy("node").agg(F.min(F.struct("parent", name.alias("name"))).alias("r")).select("node", "r.parent", "r.name")
    one = moves.filter("node is not null").groupBy("node").agg(F.min(F.struct("target")).alias("m")).select("node", "m.target", F.lit(True).alias("asked"))
    asked = store.written(spark, rows.join(one, "node", "left"), "moves")
    ids = asked.select(F.col("node").alias("target"), F.lit(True).alias("found"))
    known = lookup(asked.filter("target is not null"), ids, "target").unionByName(asked.filter("target is null").withColumn("found", F.col("asked")))
    known = store.written(spark, known, "moves")
    goes = F.col("asked") & F.col("found")
    tried = resolve(known.select("node", F.when(goes, F.col("target")).otherwise(F.col("parent")).alias("parent"), "name")).select("node", "state")
    outcome = F.when(F.col("asked").isNull(), "kept").when(F.col("found").isNull(), "PARENT_NOT_FOUND").when(F.col("state") == "cycle", "FOLDER_CYCLE").otherwise("moved")
    judged = store.written(spark, known.join(tried, "node").withColumn("outcome", outcome), "moves")
    after = resolve(judged.select("node", F.when(F.col("outcome") == "moved", F.col("target")).otherwise(F.col("parent")).alias("parent"), "name"))
    return after.join(judged.select("node", "outcome"), "node")


def trace_roots(traces: DataFrame) -> DataFrame:
    """``traces(trace, parent, root)`` held against their parents: trace, found (root), depth, verdict.

    Verdicts: ``sound``, ``wrong_root`` (another root is stored), ``parent_gone`` and ``cycle``. A null stored root means the trace itself.
    """
    tree = resolve(traces.select(F.col("trace").alias("node"), "parent", F.lit("").alias("name")))
    stored = traces.groupBy("trace").agg(F.min(F.coalesce("root", "trace")).alias("stored"))
    verdict = F.when(F.col("state") == "cycle", "cycle").when(F.col("state") == "orphan", "parent_gone").when(F.col("stored") == F.col("root"), "sound").otherwise("wrong_root")
    return tree.join(stored, F.col("node") == F.col("trace")).select("trace", F.col("root").alias("found"), "depth", verdict.alias("verdict"))


def running(df: DataFrame, group: str, order: list[str], size: Column, names: tuple[str, str] = ("position", "bytes")) -> DataFrame:
    """``df`` with two more columns, called ``names``: position (from 1) and bytes (sum of ``size`` up to the row) within each group, in the given order.

    Rows are dealt by ranges of (group, order), so a group of any size meets many tasks. Only the first group of a range can have begun in an earlier one, so
    what ranges start from is a row for each range at most, and that is what travels to all tasks. Repeated rows count each.
    """
    spark = df.sparkSession
    ranged = store.written(spark, df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_b"))
    starts = sums.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.sum("_n").over(w).alias("_n0"), F.sum("_b").over(w).alias("_b0")).filter("_n0 > 0")
    inner = Window.partitionBy("_part", group).orderBy(*order)
    rows = ranged.withColumn("_i", F.row_number().over(inner)).withColumn("_sum", F.sum("_size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(starts), (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    place, total = F.col("_i") + F.coalesce("_n0", F.lit(0)), F.col("_sum") + F.coalesce("_b0", F.lit(0))
    return rows.select(*df.columns, place.cast("long").alias(names[0]), total.cast("long").alias(names[1]))
