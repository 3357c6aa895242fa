"""Temperature mixing of sources, natively in Spark.

Token shares of the sources are raised to an exponent, found by bisection so that the mixture meets a target entropy
without any source repeating more often than allowed. The weights are realised as budgeted block permutations: a source's documents are
dealt over hashed blocks of a bounded size; whole epochs take every block, and the last epoch takes blocks in a hashed order until the source's
budget is met, the block at the edge by documents in hashed order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm import common

#: Documents of a block, at about.
BLOCK_DOCS = 2_000


@dataclass
class Mixture:
    exponent: float
    table: DataFrame  # source, weight, budget (tokens)

    @cached_property
    def _rows(self) -> list:
        return self.table.orderBy("source").collect()

    # These collect a row per source, so they are for looking at a mixture only.
    @property
    def sources(self) -> list[str]:
        return [r.source for r in self._rows]

    @property
    def weights(self) -> np.ndarray:
        return np.array([r.weight for r in self._rows], float)

    @property
    def budgets(self) -> np.ndarray:
        return np.array([r.budget for r in self._rows], float)


def weights(shares: np.ndarray, exponent: float, n: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of sources; each entry of ``shares`` stands for ``n`` alike sources and gets the weight of one."""
    w = np.where(shares > 0, shares, 1.0) ** exponent * (shares > 0)
    return w / (w * n).sum()


def entropy(w: np.ndarray, n: np.ndarray | float = 1.0) -> float:
    terms = np.where(w > 0, w * np.log(np.where(w > 0, w, 1.0)), 0.0)
    return float(-(terms * n).sum())


def solve(tokens: np.ndarray, target_entropy: float, most_repeats: float, budget: float | None, n: np.ndarray | None = None) -> tuple[float, np.ndarray, float]:
    """(exponent, weights, budget): the exponent nearest 1 whose entropy is at least ``target_entropy`` of the largest, unless the repetition limit asks for a larger one.

    Without a budget it is the smallest one that uses every document at least once. With ``n``, each entry of ``tokens`` stands for that many sources.
    """
    n = np.ones(len(tokens)) if n is None else n
    shares = tokens / (tokens * n).sum()
    goal = target_entropy * np.log(max(1, n[shares > 0].sum()))

    def spent(e: float) -> float:
        w = weights(shares, e, n)
        return budget if budget is not None else float((tokens[w > 0] / w[w > 0]).max())

    def repeats(e: float) -> float:
        w = weights(shares, e, n)
        return float((spent(e) * w[w > 0] / tokens[w > 0]).max())

    def bisect(low_is_fine) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_is_fine(mid) else (lo, mid)
        return (lo + hi) / 2

    exponent = 1.0 if entropy(weights(shares, 1.0, n), n) >= goal else bisect(lambda e: entropy(weights(shares, e, n), n) >= goal)
    if repeats(exponent) > most_repeats:  # a larger exponent repeats less, down to the budget's own share at 1
        exponent = bisect(lambda e: repeats(e) > most_repeats)
    return exponent, weights(shares, exponent, n), spent(exponent)


def mix(docs: DataFrame, target_entropy: float, most_repeats: float, budget: float | None = None, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 1) -> tuple[DataFrame, Mixture]:
    """The rows of ``docs`` in the mixture, each as often as it is drawn, with _epoch, _order (its place in the mixed stream, 0 to 1) and _tokens.

    Tokens are words. A null source counts as ''. Documents without a word, also null and empty ones, are in every epoch of their source and cost nothing; a
    source with no words at all stays as it is. Equal rows share a verdict. All columns of ``docs`` are kept; where one is named like an added column, the added one
    gets underscores at its end. Texts are not shuffled. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    added = common.free(docs, "_epoch", "_order", "_tokens")
    # Columns of the input go by their places meanwhile, so that none is mistaken for one of the columns made here.
    names = [f"in_{i}" for i in range(len(docs.columns))]
    place_of = dict(zip(docs.columns, names))
    original = docs.columns

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).alias(c) for n, c in zip(names, original)], *[F.col(c).alias(a) for c, a in zip(("_epoch", "_order", "_tokens"), added)])

    t = F.btrim(F.coalesce(F.col(place_of[text]).cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    keyed = docs.toDF(*names).withColumns({
        "_source": F.coalesce(F.col(place_of[source]).cast("string"), F.lit("")),
        "_tokens": F.when(F.length(t) > 0, F.size(F.split(t, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long"),
        "_hash": F.xxhash64(F.col(place_of[key]), F.col(place_of[text]), F.lit(seed)),
    })
    lean = common.materialize(keyed.select("_source", "_tokens", "_hash"), "mix-lean")
    totals = common.materialize(lean.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources")
    # Sources of equal size weigh the same. A row per size: of t tokens in all there are at most (2 t) ** 0.5 sizes.
    sizes = sorted((r[0], r[1]) for r in totals.filter("tokens > 0").groupBy("tokens").count().collect())
    if not sizes:
        none = totals.select(F.col("_source").alias("source"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"))
        return restored(keyed.withColumn("_epoch", F.lit(0)).withColumn("_order", F.lit(0.0))), Mixture(1.0, none)
    tokens, alike = np.array(sizes, float).T
    exponent, w, spent = solve(tokens, target_entropy, most_repeats, budget, alike)
    weighed = spark.createDataFrame([(t, x) for (t, _), x in zip(sizes, w.tolist())], "tokens long, _weight double")
    plan = totals.join(F.broadcast(weighed), "tokens", "left").fillna(0.0, ["_weight"]).withColumn("_share", F.col("_weight") * F.lit(float(spent)))
    some = F.col("tokens") > 0
    plan = plan.withColumn("_epochs", F.when(some, F.floor((F.col("_share") + 1e-6 * F.greatest("_share", F.lit(1.0))) / F.col("tokens"))).otherwise(1).cast("int"))
    plan = common.materialize(plan.select(
        "_source", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / BLOCK_DOCS)).alias("_blocks"), "_epochs",
        F.when(some, F.greatest(F.lit(0.0), F.col("_share") - F.col("_epochs") * F.col("tokens"))).otherwise(0.0).alias("_rest"),
        F.greatest("_share", F.lit(1.0)).alias("_budget"), F.col("tokens").cast("double").alias("_total"), "_weight", "_share",
    ), "mix-plan")
    found = Mixture(exponent, plan.select(F.col("_source").alias("source"), F.col("_weight").alias("weight"), F.col("_share").alias("budget")))
    plan = plan.drop("_weight", "_share")

    def blocked(df: DataFrame) -> DataFrame:
        return common.join_hot(df, plan, ["_source"], "inner", F.col("_hash")).withColumn("_block", F.pmod(F.col("_hash"), F.col("_blocks")))

    order = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "_block", F.lit(seed + 1)), "_block")
    blocks = blocked(lean).groupBy("_source", "_block", "_rest").agg(F.sum("_tokens").alias("_in_block"))
    blocks = blocks.withColumn("_before", F.sum("_in_block").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    last = F.when(F.col("_before") + F.col("_in_block") <= F.col("_rest"), "in").when(F.col("_before") < F.col("_rest"), "edge").otherwise("out")
    blocks = common.materialize(blocks.select("_source", "_block", "_in_block", "_before", last.alias("_last")), "mix-blocks")
    # The edge blocks, one a source, are taken by document.
    edges = common.materialize(blocks.filter("_last = 'edge'").select("_source", "_block", "_before"), "mix-edge-blocks")
    edge = common.join_hot(blocked(lean), edges, ["_source", "_block"], "inner", F.col("_hash"))
    upto = F.sum("_tokens").over(Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_hash", F.lit(seed + 2)), "_hash"))
    edge = edge.withColumn("_upto", upto).filter(F.col("_before") + F.col("_upto") <= F.col("_rest")).select("_source", "_hash", F.lit(True).alias("_edge")).distinct()
    edge = common.materialize(edge, "mix-edge")
    rows = common.join_hot(blocked(keyed), blocks, ["_source", "_block"], "inner", F.col("_hash"))
    rows = common.join_hot(rows, edge, ["_source", "_hash"], "left", F.col("_hash"))
    more = (F.col("_last") == "in") | F.coalesce("_edge", F.lit(False))
    rows = rows.withColumn("_n", F.col("_epochs") + more.cast("int")).filter("_n > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    jitter = F.pmod(F.xxhash64("_hash", "_epoch"), F.lit(1 << 20)) / float(1 << 20)
    place = F.when(F.col("_epoch") < F.col("_epochs"), F.col("_epoch") * F.col("_total")).otherwise(F.col("_epochs") * F.col("_total"))
    rows = rows.withColumn("_order", F.least(F.lit(1.0), (place + F.col("_before") + jitter * F.col("_in_block")) / F.col("_budget")))
    return restored(rows), found
