"""Best-fit packing of items into sequences of a fixed capacity, in bulk-synchronous rounds.

Each round takes the items of one length, longest first. They go to their successor, the smallest gap that is large enough; where items and
gaps of that size differ in number, ranks decide; the gaps are updated, and what found no place goes on to the next larger gap. Only when
none is left are sequences opened. The rounds need only know how many items have each length and how many sequences each gap, so they
run on a histogram and give the sequences of one sweep over all items, at every size. They leave a table of
runs: which ranks of a length go to which sequences, at which offset. The items are then ranked in Spark and look up their runs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm import common

#: Items that one task ranks, at about.
ROWS_PER_SWEEP = 60_000


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, items per sequence, offset) in that order, of the best fit of ``counts[length]`` items.

    A run ends where the next one of its length begins. A group of sequences with equal gaps is filled as a whole, which at least halves its gap, and a
    round splits at most two off, so the runs are bounded by the number of lengths times the logarithm of the capacity.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    gaps: list[int] = []
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[k]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            runs.append((length, counts[length] - left, first, each, capacity - gap))
            left -= full * each
            put(gap - each * length, first, full)
            if full < n:
                put(gap - left * length, first + full, 1)
                put(gap, first + full + 1, n - full - 1)
                left = 0
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def sweep(lengths: list[int], ids: list[int], bins: list[int], gaps: list[int], capacity: int) -> tuple[list, list]:
    """Best fit item by item, which ``pack`` must equal: (item, sequence, offset) placements and (sequence, gap) afterwards."""
    open_at = sorted(zip(gaps, bins))
    placed = []
    for length, item in sorted(zip(lengths, ids), key=lambda x: (-x[0], x[1])):
        k = bisect_left(open_at, (length, -1))
        gap, seq = open_at.pop(k) if k < len(open_at) else (capacity, item)
        placed.append((item, seq, capacity - gap))
        if gap > length:
            insort(open_at, (gap - length, seq))
    return placed, [(seq, gap) for gap, seq in open_at]


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Pack ``items(item_id long unique, length long 1..capacity)``: item_id, sequence_id, offset.

    Items of length null or 0 get a sequence of their own at offset 0; longer ones than ``capacity``
    raise. Ties go to the hashed order of item_id. An empty table gives an empty result. Other columns are ignored.
    """
    items = items.select("item_id", F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"))
    items = items.withColumn("length", F.when(F.col("length") > capacity, F.raise_error("an item is longer than the capacity")).otherwise(F.col("length")))
    whole = (F.col("length") == 0) | (F.col("length") == capacity)
    alone = items.filter(whole).select("item_id", F.col("item_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect() if 0 < r[0] < capacity}  # at most ``capacity`` rows
    if not counts:
        return alone
    spark = items.sparkSession
    runs = spark.sparkContext.broadcast(rounds(counts, capacity))
    bits = max(counts.values()).bit_length()
    # Ranks within a length: items are dealt by hash over parts of a bounded size, and the parts of a length follow each other.
    parts = spark.createDataFrame([(v, -(-n // ROWS_PER_SWEEP)) for v, n in counts.items()], "length long, parts long")
    dealt = items.filter(~whole).join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts"))).select("item_id", "length", "part")
    sizes = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = common.materialize(sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "packing-parts")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("item_id"))
    ranked = dealt.withColumn("within", within).join(F.broadcast(sizes), ["length", "part"])  # a row per length, and one more per ROWS_PER_SWEEP items at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        starts = table[:, 0] << bits | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (1, 2))
            run = table[np.searchsorted(starts, length << bits | rank, side="right") - 1]
            sequence, nth = np.divmod(rank - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(run[:, 2] + sequence), pa.array(run[:, 4] + nth * length)], ["item_id", "sequence", "offset"])

    placed = ranked.select("item_id", "length", (F.col("before") + F.col("within") - 1).cast("long").alias("rank")).mapInArrow(place, "item_id long, sequence long, offset long")
    placed = common.materialize(placed, "packing")
    # A sequence bears the id of the item that opened it.
    openers = placed.filter("offset = 0").select("sequence", F.col("item_id").alias("sequence_id"))
    return alone.unionByName(placed.join(openers, "sequence").select("item_id", "sequence_id", "offset"))
