"""Themes of vectors: bisecting clusters by cosine that come out alike however the rows are partitioned.

Seeds are drawn by a hash of the id, centres are sums of whole numbers, and each row is scored by itself, so neither the
order of rows nor of tasks matters. Every pass is one scan that hands two sums of the vectors' width to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.vectors import matrix_of, unit_rows
from keepsake.operators.retrieval import usable_vectors
from keepsake.session import fresh_path

FIXED_POINT = 1 << 24  # a component of a unit vector as a whole number
_ALIKE = 1 - 1e-9


class Splits:
    """A tree of splits: leaf number -> (number of the new leaf, the two centres), in the order they were made."""

    def __init__(self):
        self.made: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row. A row that is as near to both centres stays with the older leaf."""
        out = np.zeros(len(unit), dtype=np.int32)
        for old, new, stay, leave in self.made:
            out[(out == old) & (_to(unit, leave) > _to(unit, stay))] = new
        return out


def _to(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", unit, centre)  # row by row, so the size of the batch changes no digit


def _scan(vectors: DataFrame, work, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch, unit_rows(matrix_of(batch["embedding"])))

    return vectors.mapInArrow(each, schema)


def _leaf_rows(vectors: DataFrame, splits: Splits) -> DataFrame:
    def work(batch, unit):
        yield pa.RecordBatch.from_arrays([batch["id"], batch["order"], batch["embedding"], pa.array(splits.leaves(unit))],
                                         names=["id", "order", "embedding", "theme"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return _scan(vectors, work, f"id {id_type}, order long, embedding array<float>, theme int")


def _centres(members: DataFrame, pair: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The means of the members nearer to either of two centres, from exact sums."""
    def work(batch, unit):
        side = _to(unit, pair[1]) > _to(unit, pair[0])
        whole = np.rint(unit * FIXED_POINT).astype(np.int64)
        for s in (0, 1):
            total = whole[side == s].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), s, dtype=np.int32)),
                                              pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["side", "at", "total"])

    sums = _scan(members, work, "side int, at int, total long").groupBy("side", "at").agg(F.sum("total").alias("total"))
    out = [np.zeros_like(c) for c in pair]
    for side, at, total in sums.collect():  # twice the width
        out[side][at] = total
    lengths = [np.linalg.norm(c) for c in out]
    return tuple(c / n if n else old for c, n, old in zip(out, lengths, pair))


def _seeds(members: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The member with the smallest hash, and the one least similar to it; None if all point the same way."""
    first = members.orderBy("order", "id").select("embedding").limit(1).collect()
    one = unit_rows(np.array([first[0][0]], dtype=np.float64))[0]

    def work(batch, unit):
        sims = _to(unit, one)
        at = np.lexsort((batch["order"].to_numpy(), sims))[:1]
        yield pa.RecordBatch.from_arrays([pa.array(sims[at]), batch["order"].take(pa.array(at)), batch["embedding"].take(pa.array(at))],
                                         names=["similarity", "order", "embedding"])

    far = _scan(members, work, "similarity double, order long, embedding array<float>").orderBy("similarity", "order", "embedding").limit(1).collect()
    return None if far[0][0] > _ALIKE else (one, unit_rows(np.array([far[0][2]], dtype=np.float64))[0])


def bisected_themes(thoughts: DataFrame, n: int = 5, rounds: int = 4) -> DataFrame:
    """Thoughts with the theme of their vector: ``id, theme``, at most ``n`` themes.

    The largest theme is halved until there are ``n`` or none can be halved; of equally large ones the older. Null, zero
    and NaN vectors have no theme, nor have those of another width than most (the smaller of two equally frequent
    ones). Rows alike in their vector share a theme; repeated ids are each given theirs. An empty table gives no rows.
    """
    usable = usable_vectors(thoughts).select("id", F.col("embedding").cast("array<float>").alias("embedding"),
                                             F.xxhash64("id", "embedding").alias("order"))
    widths = usable.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    splits = Splits()
    path = fresh_path(thoughts.sparkSession, "themes")
    usable.where(F.size("embedding") == (widths[0][0] if widths else 0)).select("id", "order", "embedding").write.parquet(path)
    vectors = thoughts.sparkSession.read.schema("id " + usable.schema["id"].dataType.simpleString()
                                                + ", order long, embedding array<float>").parquet(path)
    whole = set()
    while len(splits.made) + 1 < n:
        sizes = sorted((-count, leaf) for leaf, count in _leaf_rows(vectors, splits).groupBy("theme").count().collect() if leaf not in whole)
        if not sizes or sizes[0][0] > -2:
            break
        leaf = sizes[0][1]
        members = _leaf_rows(vectors, splits).where(F.col("theme") == leaf).drop("theme")
        pair = _seeds(members)
        if pair is None:
            whole.add(leaf)
            continue
        for _ in range(rounds):
            pair = _centres(members, pair)
        splits.made.append((leaf, len(splits.made) + 1, *pair))
    return _leaf_rows(vectors, splits).select("id", "theme")


def theme_labels(themes: DataFrame, topics: DataFrame) -> DataFrame:
    """The most frequent topic of each theme, ties by name: ``theme, topic, thoughts``. ``topics``: ``id, topic``."""
    counted = themes.join(topics.where("topic IS NOT NULL"), "id").groupBy("theme", "topic").agg(F.count(F.lit(1)).alias("thoughts"))
    order = Window.partitionBy("theme").orderBy(F.desc("thoughts"), "topic")
    return counted.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
