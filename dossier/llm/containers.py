"""Problem 8: filling fixed-capacity containers with items of varying length.

Best fit in bulk-synchronous steps.  Units (items, or bundles of small ones) and gaps of
containers are range-sorted together by size.  A step is a distributed successor sweep: every
task sweeps its range upwards and gives each gap the largest unit below it that no smaller gap
has taken.  What a range can't settle, units without a gap and gaps without a unit, is settled
by rank: the numbers left over in each range say which unit of which range goes to which gap,
and those rows alone are joined.  Then the gaps are updated, and the next step follows.  Where
no unit fits any gap, as many containers as the rest needs at least are opened, each with one
of the largest units.  A rest of at most REST rows is swept by one task until nothing is left,
by the same rule, so its result is the same.

The driver sees two numbers for each range and step, and a step has as many ranges as its rows
need, so that later steps cost it less.  Gaps below the least unit are dropped.  Sorting by size
and key spreads a size that a third of the items share over several ranges.

Defined results: null and empty texts are left out; an item above the capacity becomes
full parts and a rest; equal sizes are ranked by key; no input gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.tokens import VOCABULARY, token_counts
from dossier.plans.shared import cut, table

CAPACITY = 4096
#: Parts below this share of the capacity are bundled until they reach it, so that the number of steps doesn't depend on them.
SMALL = 1 / 256
#: Rows (units and gaps) that one task may sweep to the end.
REST = 20_000
UNIT, GAP = 0, 1


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing on counts, the yardstick of the packing in tests: (size, first rank, items, first container, items in each container)."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, opened = [], 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError("sizes must be positive and within the capacity")
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first = capacity, opened
                number = -(-left // (capacity // size))
                opened += number
            each = gap // size
            whole = min(number, left // each)
            if whole:
                plan.append((size, rank, whole * each, first, each))
                leave(gap - each * size, first, whole)
                rank, left, first, number = rank + whole * each, left - whole * each, first + whole, number - whole
            if left and number:
                plan.append((size, rank, left, first, left))
                leave(gap - left * size, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            leave(gap, first, number)
    return plan


def sized_parts(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, part, start, tokens): each item as parts of at most ``capacity``; only larger items are split."""
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col(size_col) / capacity).cast("int") - 1))
    sizes = sizes.where(F.col(size_col) > 0).select(id_col, F.col(size_col).alias("__size"), parts.alias("part"))
    start = F.col("part").cast("bigint") * capacity
    return sizes.select(id_col, "part", start.alias("start"), F.least(F.lit(capacity), F.col("__size") - start).cast("int").alias("tokens"))


def bundled(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` with the key of the ``unit`` of each: itself, or a bundle of small parts of its partition."""
    least = max(1, int(capacity * SMALL))
    at = parts.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, filled = TaskContext.get().partitionId() << 33, None, 0
        for batch in batches:
            units = []
            for tokens in batch.column(at).to_pylist():
                if tokens < least:
                    if open_ is None or filled + tokens > 2 * least or filled + tokens > capacity:
                        key, open_, filled = key + 1, key, 0
                    units.append(open_)
                    filled += tokens
                    if filled >= least:
                        open_ = None
                else:
                    units.append(key)
                    key += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.int64())], names=[*batch.schema.names, "unit"])

    return parts.mapInArrow(run, T.StructType([*parts.schema.fields, T.StructField("unit", T.LongType())]))


STATE = "size int, kind int, key bigint"
#: A pair has the unit in ``key`` and the container in ``container``, and what is left of the gap; a row left over has its range and its rank in it.
SWEPT = "size int, kind int, key bigint, container bigint, left int, range int, rank bigint"


def _rows(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, ascending by size, units before gaps: each gap takes the last unit that is still free."""
    own, waiting, empty = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        rows = []
        for size, kind, key in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == UNIT:
                waiting.append((size, key))
            elif waiting:
                taken, unit = waiting.pop()
                rows.append((taken, UNIT, unit, key, size - taken, None, None))
            else:
                rows.append((size, GAP, key, None, None, own, empty))
                empty += 1
        yield _rows(list(map(list, zip(*rows))) or [[]] * 7, SWEPT)
    for start in range(0, len(waiting), 10_000):
        part = [(size, UNIT, key, None, None, own, len(waiting) - 1 - k) for k, (size, key) in enumerate(waiting[start : start + 10_000], start)]
        yield _rows(list(map(list, zip(*part))), SWEPT)


def settle(units: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range of units, first rank, range of gaps, first rank, number): which left-over units go to which left-over gaps.

    The gaps of a range come before its units: they take the units of the ranges below, the nearest first.
    """
    waiting, out = [], []
    for place in sorted(units.keys() | gaps.keys()):
        taken, number = 0, gaps.get(place, 0)
        while number and waiting:
            below, rank, left = waiting.pop()
            both = min(left, number)
            out.append((below, rank, place, taken, both))
            taken, number = taken + both, number - both
            if left > both:
                waiting.append((below, rank + both, left - both))
        if units.get(place):
            waiting.append((place, 0, units[place]))
    return out


def _paired(pairs: list[tuple[int, int, int | None, int, int]]):
    """Rows left over with the number of the ``pair`` that each belongs to, null for none; pairs without a range of gaps open containers."""
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    base = 0
    for below, rank, place, taken, number in pairs:
        spans.setdefault((UNIT, below), []).append((rank, number, base))
        if place is not None:
            spans.setdefault((GAP, place), []).append((taken, number, base))
        base += number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranges, ranks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "range", "rank"))
            pair = np.full(batch.num_rows, -1, np.int64)
            for kind, place in spans.keys() & set(zip(kinds.tolist(), ranges.tolist())):
                first, number, start = np.array(spans[kind, place]).T
                at = np.flatnonzero((kinds == kind) & (ranges == place))
                span = np.searchsorted(first, ranks[at], side="right") - 1  # the first span of a range starts at rank 0
                ahead = ranks[at] - first[span]
                pair[at] = np.where(ahead < number[span], start[span] + ahead, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("size", "kind", "key")), pa.array(pair, mask=pair < 0)], names=["size", "kind", "key", "pair"])

    return run


def finish(sizes: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int, opened: int) -> list[tuple[int, int]]:
    """(unit, container) of all units (size, key), by steps over the units and the gaps (size, container) that are left."""
    out, units, gaps = [], sorted(sizes), list(gaps)
    while units:
        waiting: list[tuple[int, int]] = []
        after: list[tuple[int, int]] = []
        placed = False
        for size, kind, key in sorted([(s, UNIT, k) for s, k in units] + [(s, GAP, k) for s, k in gaps]):
            if kind == UNIT:
                waiting.append((size, key))
            elif waiting:
                taken, unit = waiting.pop()
                out.append((unit, key))
                placed = True
                if size > taken:
                    after.append((size - taken, key))
            else:
                after.append((size, key))
        units, gaps = waiting, after
        if not placed and units:
            number = -(-sum(s for s, _ in units) // capacity)
            for size, unit in reversed(units[-number:]):
                out.append((unit, opened))
                if size < capacity:
                    gaps.append((capacity - size, opened))
                opened += 1
            units = units[:-number]
    return out


def place_units(units: DataFrame, capacity: int) -> DataFrame:
    """(unit, container) of units (unit, size)."""
    spark = units.sparkSession
    state = cut(units.select(F.col("size").cast("int").alias("size"), F.lit(UNIT).alias("kind"), F.col("unit").alias("key")))
    most = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done, opened = [], 0
    while True:
        unit_size = F.when(F.col("kind") == UNIT, F.col("size"))
        rows = state.agg(F.count(F.lit(1)).alias("n"), F.count(unit_size).alias("units"), F.coalesce(F.sum(unit_size), F.lit(0)).alias("tokens"), F.min(unit_size).alias("least")).first()
        if not rows["units"]:
            break
        # Units only get fewer, so a gap below the least one stays as it is.
        state = state.where((F.col("kind") == UNIT) | (F.col("size") >= rows["least"]))
        number = state.count() if rows["units"] <= REST < rows["n"] else rows["n"]
        if number <= REST:
            first = opened

            def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                left = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
                found = finish([(s, k) for s, kind, k in left if kind == UNIT], [(s, k) for s, kind, k in left if kind == GAP], capacity, first)
                yield _rows(list(map(list, zip(*found))) or [[]] * 2, "unit bigint, container bigint")

            done.append(state.coalesce(1).mapInArrow(rest, "unit bigint, container bigint"))
            break
        ranges = min(most, max(2, -(-4 * number // REST)))
        ordered = state.repartitionByRange(ranges, "size", "kind", "key").sortWithinPartitions("size", "kind", "key")
        swept = cut(ordered.mapInArrow(_sweep, SWEPT))
        left: dict[int, dict[int, int]] = {UNIT: {}, GAP: {}}
        for r in swept.where("range IS NOT NULL").groupBy("kind", "range").count().collect():  # two numbers for each range
            left[r["kind"]][r["range"]] = r["count"]
        pairs = settle(left[UNIT], left[GAP])
        # No gap took a unit within its range; none could from another range either, unless there are pairs.
        opening = -(-rows["tokens"] // capacity) if not pairs and sum(left[UNIT].values()) == rows["units"] else 0
        if opening:
            to_open = opening
            for place in sorted(left[UNIT], reverse=True):  # the largest units come first
                if taken := min(to_open, left[UNIT][place]):
                    pairs.append((place, 0, None, 0, taken))
                    to_open -= taken
        # Neither this nor what follows is a join: a join's estimated size is the product of its sides', which checkpoints
        # keep, so that the digits of the estimate would double in each step.
        alone = swept.where("range IS NOT NULL").mapInArrow(_paired(pairs), STATE + ", pair bigint")
        met = alone.where("pair IS NOT NULL")
        if opening:
            matched = met.select("size", "key", (F.col("pair") + opened).alias("container"), (F.lit(capacity) - F.col("size")).cast("int").alias("left"))
            opened += opening
        else:
            matched = swept.where("range IS NULL").select("size", "key", "container", "left")
            if pairs:
                of = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
                both = met.groupBy("pair").agg(of(UNIT, "size").alias("size"), of(UNIT, "key").alias("key"), of(GAP, "key").alias("container"), of(GAP, "size").alias("gap"))
                matched = matched.unionByName(both.select("size", "key", "container", (F.col("gap") - F.col("size")).cast("int").alias("left")))
        matched = cut(matched.coalesce(ranges))
        done.append(matched.select(F.col("key").alias("unit"), "container"))
        kept = alone.where("pair IS NULL").select("size", "kind", "key")
        state = cut(kept.unionByName(matched.where("left > 0").select(F.col("left").alias("size"), F.lit(GAP).alias("kind"), F.col("container").alias("key"))).coalesce(ranges))
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "unit bigint, container bigint")


def fill_containers(parts: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (id_col, part, start, tokens) with the number of the ``container`` of each."""
    parts = cut(bundled(parts.select(id_col, "part", "start", "tokens"), capacity))
    units = parts.groupBy("unit").agg(F.sum("tokens").alias("size"))
    return parts.join(place_units(units, capacity), "unit").select(id_col, "part", "start", "tokens", "container")


def p8_assignment(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, start, tokens, container) of every non-empty document."""
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    return fill_containers(sized_parts(token_counts(documents, "doc_id", "text", vocabulary), "doc_id", "tokens"), "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, unused_share, largest) of the whole assignment."""
    filled = p8_assignment(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = filled.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("largest"))
    return total.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, overfull, split_without_need): assigned documents, containers above the capacity, and documents split although they fit."""
    rows = cut(p8_assignment(spark, sf_dir))
    overfull = rows.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).cast("int").alias("overfull"))
    each = rows.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("parts"))
    each = each.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") <= CAPACITY) & (F.col("parts") > 1)).cast("int").alias("split_without_need"))
    return each.crossJoin(overfull)
