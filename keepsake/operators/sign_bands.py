"""Similar pairs by banded signs.

A vector's signs on random planes are cut into bands. Vectors that agree on all signs of a band meet in a bucket, and
only those are scored, exactly. Two vectors at an angle w agree on a sign with probability 1 - w / pi, so the bands
that a threshold and a wanted recall need are known beforehand. Rows that travel grow with the vectors times the
bands, not with their square; a bucket of any size is cut into blocks that meet pair by pair. Vectors travel with
their signs of all bands, so that a pair is listed only where it meets first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsake.functions.vectors import matrix_of
from keepsake.operators import retrieval
from keepsake.operators.retrieval import (DEFAULT_THRESHOLD, distinct_vectors, numbers_of, pair_block_rows, pair_rows, pairs_of_copies,
                                          pairs_schema, places_above, similar_pairs, with_partners, written)

BLOCK_ROWS = 65536  # vectors of one bucket that one side of a comparison holds at most; see also retrieval.PAIR_BYTES
SHELF_ROWS = 4096  # buckets of so many vectors at most share a shelf
ROW_COST = 512  # moving a vector to a bucket and into Python costs as much as so many comparisons in a matrix product
MOST_COPIES = 32  # times that the vectors are written for a shuffle, where some plan needs no more
BROADCAST_BUCKETS = 100_000
MAX_BITS = 40
_PART = 1 << 16  # pairs whose signs are compared at once


def copies_of(n: int, bits: int, bands: int, width: int = 1) -> int:
    """Times that a plan writes ``n`` vectors for a shuffle: once for each band and block of a bucket."""
    return bands * max(1, math.ceil(n / 2 ** bits / pair_block_rows(width, BLOCK_ROWS)))


def band_plan(n: int, threshold: float, recall: float, always: bool = False, width: int = 1) -> tuple[int, int] | None:
    """Signs per band and number of bands that cost least for ``n`` vectors and find a pair at the threshold with
    probability ``recall``, one above it more often. None where comparing all vectors costs less, unless ``always``.

    A low threshold would take hundreds of bands, each a copy of all vectors on disk, to save comparisons: plans of at most
    ``MOST_COPIES`` go first, and where there is none, that of the fewest copies."""
    agree = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    plans = []
    for bits in range(1, MAX_BITS + 1):
        meet = agree ** bits
        if meet < 1e-9:
            break
        bands = 1 if meet >= recall else math.ceil(math.log1p(-recall) / math.log1p(-meet))
        copies = copies_of(n, bits, bands, width)
        plans.append((max(copies, MOST_COPIES), copies * n * ROW_COST + bands * n * n / 2 ** (bits + 1), bits, bands))
    if not plans or (not always and min(plans)[1] >= n * ROW_COST + n * n / 2):
        return None
    return min(plans)[2:]


def _code(bits: int) -> np.dtype:
    """The number that holds the signs of a band."""
    return np.dtype(next(f"<u{size}" for size in (1, 2, 4, 8) if bits <= 8 * size))


def marked(vectors: DataFrame, bits: int, bands: int, seed: int = 17) -> DataFrame:
    """``vectors`` with ``width`` and ``signs``, those of all bands one after the other. Planes depend on seed, width and band only, so a
    repeated task gives the same."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("signs", T.BinaryType())])
    arrow, weights, code = to_arrow_schema(schema), 1 << np.arange(bits, dtype=np.int64), _code(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch["embedding"])
            for width in pc.unique(sizes).to_pylist():
                own = batch.filter(pc.equal(sizes, width))
                rows = matrix_of(own["embedding"])
                codes = np.empty((len(rows), bands), code)
                for band in range(bands):
                    planes = np.random.default_rng([seed, width, band]).standard_normal((width, bits))
                    codes[:, band] = ((rows @ planes) > 0) @ weights
                signs = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(rows), width, dtype=np.int32)), signs], schema=arrow)

    return vectors.mapInArrow(cut, schema)


def _of_bands(marks: DataFrame, bits: int, bands: int) -> DataFrame:
    """Rows of ``marked``, once for each band: with ``band`` and the ``signs`` of that band."""
    size = _code(bits).itemsize
    rows = marks.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    return rows.withColumn("signs", F.substring("signs", F.col("band") * size + 1, F.lit(size)))


def signed(vectors: DataFrame, bits: int, bands: int, seed: int = 17) -> DataFrame:
    """``id, width, band, signs`` of every vector and band."""
    return _of_bands(marked(vectors.select("id", "embedding"), bits, bands, seed), bits, bands).select("id", "width", "band", "signs")


def bucket_rows(keyed: DataFrame) -> DataFrame:
    """Rows of ``signed`` whose bucket holds others too, once for each comparison they take part in: with ``shelf, low, high,
    block``. Small buckets share a shelf; the blocks ``low`` and ``high`` of a large one meet on a shelf of its own."""
    bucket = ["width", "band", "signs"]
    crowded = written(keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(retrieval.PAIR_BYTES // 8) / F.greatest(F.lit(1), "width"))))
    small = F.col("n") <= F.least(room, F.lit(SHELF_ROWS))
    buckets, shared = crowded.agg(F.count(F.lit(1)), F.sum(F.when(small, F.col("n")))).first()
    shelves = max(1, math.ceil((shared or 0) / SHELF_ROWS))
    shelf = F.when(small, F.pmod(F.xxhash64(*bucket), F.lit(shelves))).otherwise(F.xxhash64(*bucket))
    placed = crowded.select(*bucket, F.ceil(F.col("n") / room).cast("int").alias("blocks"), shelf.alias("shelf"))
    rows = keyed.join(F.broadcast(placed) if buckets <= BROADCAST_BUCKETS else placed, bucket)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return with_partners(rows, F.col("blocks")).select("id", *bucket, "shelf", "block", "low", "high")


def _scored(rows: DataFrame, marks: DataFrame, bits: int, threshold: float, cross_day: bool, schema: T.StructType) -> DataFrame:
    """The pairs above the threshold that share a bucket, each once: where they meet in their first common band."""
    arrow, code = to_arrow_schema(schema), _code(bits)
    facts = ("thought", "copies", "first_day", "last_day")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        table = pa.Table.from_batches(list(batches))
        numbers = numbers_of(table, width)
        block, band, *told = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("block", "band", *facts))
        codes = np.frombuffer(b"".join(table["signs"].to_pylist()), code).reshape(len(band), -1)
        signs = codes[np.arange(len(band)), band]
        order = np.lexsort((signs, band))
        ends = np.nonzero((band[order][1:] != band[order][:-1]) | (signs[order][1:] != signs[order][:-1]))[0] + 1
        for own in np.split(order, ends):
            a, b = (own, own) if low == high else (own[block[own] == low], own[block[own] == high])
            earlier = codes[:, :band[own[0]]]
            for i, j, s in places_above(numbers, a, b, threshold, low == high):
                for at in range(0, len(i), _PART):
                    p, q = i[at:at + _PART], j[at:at + _PART]
                    first = ~(earlier[p] == earlier[q]).any(axis=1)
                    yield from pair_rows(told, p[first], q[first], s[at:at + _PART][first], cross_day, arrow)

    moved = marks.select("id", "embedding", "signs", *facts)
    return rows.drop("signs").join(moved, "id").groupBy("width", "shelf", "low", "high").applyInArrow(meet, schema)


def near_pairs(thoughts: DataFrame, threshold: float = DEFAULT_THRESHOLD, recall: float = 0.95, cross_day: bool = True,
               start=None, end=None, always: bool = False, seed: int = 17) -> DataFrame:
    """``similar_pairs`` without comparing all vectors: ``id_a, id_b, copies_a, copies_b, similarity``.

    Every pair returned is above the threshold, with its exact similarity; a pair at the threshold is found with
    probability ``recall``, a closer one with a higher one. Where bands would cost more than the whole grid (few
    vectors, low thresholds) the exact search takes over, unless ``always``. Exact copies stand as one vector and are
    always found; null, zero and NaN vectors have no pairs, and vectors of different widths none with each other.
    """
    groups = distinct_vectors(thoughts, start, end)
    n, width = groups.agg(F.count("*"), F.max(F.size("embedding"))).first()
    plan = band_plan(n, threshold, recall, always, width or 1)
    if plan is None:
        return similar_pairs(thoughts, threshold, cross_day, start, end)
    # Numbers of their own name the vectors: an id may stand for several.
    named = groups.where("id IS NOT NULL").withColumnRenamed("id", "thought").withColumn("id", F.monotonically_increasing_id())
    marks = written(marked(named, *plan, seed), "signs")
    rows = bucket_rows(_of_bands(marks.select("id", "width", "signs"), *plan))
    return _scored(rows, marks, plan[0], threshold, cross_day, pairs_schema(thoughts)).unionByName(pairs_of_copies(groups, threshold, cross_day))
