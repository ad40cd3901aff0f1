"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import same, whole, word_count, written

UNIT = ("doc_id", "source", "text_hash", "size")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_copies: float = 3.0) -> DataFrame:
    """``source``, ``source_size``, ``target``: what each source should give, all sources together 100%.

    ``sizes`` has ``source`` and ``size``. Sources are ordered by code point, null last, and take the weights in
    turn. A target stops at ``max_copies`` times its source's size; the excess is shared again by weight until
    none is above. That fixed point is one level: target = min(cap, level * weight); it is found from running
    sums over the sources in order of cap / weight, so no loop is needed. The only global sort is over sources.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    base = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
            .withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(onward))
    levels = base.withColumn("level", level)
    found = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return (levels.withColumn("level", F.coalesce(found, F.lit(0.0)))
            .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def pair_off(mass: np.ndarray, full: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of one list: the mass of each unit becomes 0 or full, but for at most one left between.

    Two units that are both between meet at a time. Mass moves from one to the other until one is empty or full;
    the direction is drawn so that each unit keeps its expected mass. The sum never changes.
    """
    out = mass.copy()
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < full[i]:
            continue
        if held < 0:
            held = i
            continue
        total, a, b = out[held] + out[i], full[held], full[i]
        high, low = min(a, total), total - min(b, total)
        if draws[i] * (high - low) < out[held] - low:
            out[held], out[i] = high, (0.0 if high == total else total - high)
        else:
            out[held], out[i] = (0.0 if low <= 0.0 else low), min(b, total)
        if not 0.0 < out[held] < a:
            held = i if 0.0 < out[i] < b else -1
    return out


def _round_lists(seed: int, last: bool):
    """For one group of units: pair off each source's list. ``last``: also decide what is left by its chance."""

    def rounded(key: tuple[pa.Scalar, ...], units: pa.Table) -> pa.Table:
        units = units.sort_by([("source", "ascending"), ("draw_key", "ascending"), ("doc_id", "ascending"),
                               ("text_hash", "ascending"), ("size", "ascending")])
        source = units["source"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        mass = np.array(units["mass"].to_numpy(), dtype=float)
        full = np.array(units["full"].to_numpy(), dtype=float)
        draws = np.random.default_rng([seed, *(int(k.as_py()) for k in key)]).random(len(mass) + 1)
        cuts = [0, *(np.flatnonzero(np.diff(source)) + 1), len(mass)] if len(mass) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            mass[a:b] = pair_off(mass[a:b], full[a:b], draws[a:b])
            if last:
                mass[a:b] = np.where((mass[a:b] > 0) & (mass[a:b] < full[a:b]),
                                     np.where(draws[a + 1:b + 1] * full[a:b] < mass[a:b], full[a:b], 0.0), mass[a:b])
        return units.set_column(units.schema.get_field_index("mass"), "mass", pa.array(mass))

    return rounded


def _rounded_units(docs: DataFrame, weights: Sequence[float], max_copies: float, seed: int, bucket_units: int,
                   fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The rows (with ``task``, the file they were written to), and for each unit its number of rows ``times`` and of copies ``total``."""
    rows = written(docs.select("doc_id", "source", F.xxhash64(whole()).alias("text_hash"), word_count(whole()).alias("size"),
                               F.spark_partition_id().alias("task")), "mix-rows")
    targets = written(source_targets(rows.select("source", "size"), weights, max_copies), "mix-targets")
    alike = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("times"))
    units = alike.join(targets, same(alike, targets, "source")).drop(targets["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = F.least(share, F.lit(float(max_copies))) * F.col("times")
    units = units.select(*UNIT, "source_size", "target", "times", F.floor(expected).alias("base"), F.col("size").cast("double").alias("full"),
                         ((expected - F.floor(expected)) * F.col("size")).alias("mass"), F.xxhash64(*UNIT, F.lit(seed)).alias("draw_key"))
    buckets = max(1, -(-rows.count() // bucket_units))
    level = units.withColumn("node", F.pmod(F.xxhash64("draw_key"), F.lit(buckets)))
    columns = level.columns
    done = []
    while True:
        last = buckets == 1
        step = written(level.groupBy("node").applyInArrow(_round_lists(seed, last), level.schema), "mix-level")
        between = (F.col("mass") > 0) & (F.col("mass") < F.col("full"))
        done.append(step.where(~between))
        if last:
            break
        level = step.where(between).withColumn("node", F.floor(F.col("node") / fan_in)).select(*columns)
        buckets = -(-buckets // fan_in)
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    return rows, decided.select(*UNIT, "source_size", "target", "times", (
        F.col("base") + F.when(F.col("mass") > 0, 1).otherwise(0)).cast("long").alias("total"))


def _share_of(before: str, rows: str) -> Column:
    """Copies that fall to ``rows`` rows of a unit after the ``before`` first ones: equal parts, and one more for the first of them."""
    whole_part, extra = F.floor(F.col("total") / F.col("times")), F.col("total") % F.col("times")
    return (whole_part * F.col(rows) + F.least(F.greatest(extra - F.col(before), F.lit(0)), F.col(rows))).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_copies: float = 3.0, seed: int = 7,
                bucket_units: int = 50_000, fan_in: int = 16) -> DataFrame:
    """Copies of each document such that each source gives what its weight asks for.

    Returns one row per row of ``docs``: ``doc_id, source, size, source_size, target, copies``. The size of a
    document is its number of words. Every document of a source expects target / source_size copies. Rows alike in doc_id,
    source and text are one unit, which expects as many times that: the whole part is given, the fraction, which is less
    than one document, is rounded by pivotal sampling on word mass, so a source's words differ from its target by less than
    one document. A unit's copies are dealt to its rows in equal parts, the first rows getting one more. Units are dealt to
    buckets by hash, so a hot source is spread; each bucket leaves one fractional unit per source, and those meet ``fan_in`` at
    a time up a tree. Buckets and draws depend on the rows alone, so reruns agree. A unit's rows are numbered within the
    files they come in, so that one of very many rows is not numbered by one task.

    Null text: size 0, like a text without words; such documents take nothing and get the whole part of the
    copies. Null source: a source of its own, last in order. Null doc_id: a value like any other. An empty table gives no rows. Other
    columns are ignored.
    """
    rows, decided = _rounded_units(docs, weights, max_copies, seed, bucket_units, fan_in)
    counts = rows.groupBy(*UNIT, "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*UNIT).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    own = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*UNIT, "task").orderBy("doc_id")) - 1).withColumn("one", F.lit(1))
    placed = own.join(starts, same(own, starts, *UNIT, "task")).select(own["*"], (F.col("start") + F.col("nth")).alias("place"))
    joined = placed.join(decided, same(placed, decided, *UNIT), "left")
    return joined.select(placed["doc_id"], placed["source"], placed["text_hash"], placed["size"], "source_size", "target",
                         _share_of("place", "one").alias("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_copies: float = 3.0, seed: int = 7,
                    bucket_units: int = 50_000, fan_in: int = 16) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it. Same columns as ``docs``. A unit's rows that differ in
    other columns get their copies in the order of a hash of the row."""
    _, decided = _rounded_units(docs, weights, max_copies, seed, bucket_units, fan_in)
    counts = decided.where("total > 0").select("doc_id", "source", "text_hash", "times", "total")
    row = F.struct(*[docs[c] for c in docs.columns])
    keyed = docs.select(row.alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.xxhash64(whole(docs["text"])).alias("text_hash"))
    keys = ("doc_id", "source", "text_hash")
    joined = keyed.join(counts, same(keyed, counts, *keys)).select(keyed["*"], "times", "total")
    variants = (joined.where("times > 1").groupBy(*keys, "times", "total", F.xxhash64("row").alias("variant"))
                .agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy(*keys).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)
    several = variants.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("row", _share_of("before", "n").alias("copies"))
    taken = joined.where("times = 1").select("row", F.col("total").alias("copies")).unionByName(several).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
