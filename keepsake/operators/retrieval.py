"""Vector search: one query, many queries, similar pairs, novelty and chunks.

Exact search over one query is a scan with a top-k, nothing is shuffled. Everything that compares
vectors with vectors runs on a grid of blocks: rows are hashed by id into blocks of bounded size, each
pair of blocks is one group, and a group is one matrix product in numpy. Blocks depend on ids only, so
equal or similar vectors, however many, spread evenly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsake.functions.dates import moment
from keepsake.functions.predicates import json_contains
from keepsake.functions.text import chunk_array
from keepsake.functions.vectors import matrix_of, similarity_to, unit_rows
from keepsake.session import fresh_path

DEFAULT_THRESHOLD = 0.7
DEFAULT_COUNT = 10
BLOCK_ROWS = 8192
BROADCAST_BYTES = 64 * 1024 * 1024
PAIR_ROWS = 65536  # where similar pairs are listed, vectors of a block at most: each vector goes once to every block
PAIR_BYTES = 32 * 1024 * 1024  # and their size, eight bytes a number
PAIR_BLOCKS = 16  # blocks of BLOCK_ROWS there, for the sake of many tasks, as long as there are no more
_TILE = 1024  # a tile of similarities has at most so many numbers squared, 8 MB


def match_thoughts(thoughts: DataFrame, query_vec, threshold: float = DEFAULT_THRESHOLD,
                   k: int = DEFAULT_COUNT, filter: dict | None = None,
                   promoted: dict | None = None) -> DataFrame:
    """The ``k`` thoughts most similar to a query vector: ``id, content, metadata, similarity,
    created_at``, best first, ties by id.

    Only similarities strictly above ``threshold`` count; thoughts without an embedding never match.
    ``filter`` is a metadata document that must be contained; it is applied below the similarity, so
    filtered rows are never scored. ``promoted`` names typed columns that repeat metadata keys.
    """
    rows = thoughts.where(F.col("embedding").isNotNull())
    if filter:
        rows = rows.where(json_contains("metadata", filter, promoted))
    scored = rows.select("id", "content", "metadata",
                         similarity_to("embedding", query_vec, once=True).alias("similarity"), "created_at")
    return (scored.where(F.col("similarity") > threshold)
            .orderBy(F.col("similarity").desc(), F.col("id").asc()).limit(k))


def _width(vectors: DataFrame) -> int:
    """Largest dimension in a table of vectors (1 for an empty one)."""
    return max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)


def _block_count(rows: int, width: int) -> int:
    per_block = max(1, min(BLOCK_ROWS, BROADCAST_BYTES // (8 * width)))
    return max(1, math.ceil(rows / per_block))


def usable_vectors(df: DataFrame, *extra) -> DataFrame:
    """Usable vectors only: present, not zero, no NaN."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.where(F.col("embedding").isNotNull()).where(F.nanvl(norm, F.lit(0.0)) > 0).select(
        "id", "embedding", *extra)


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def _pair_blocks(left: DataFrame, right: DataFrame):
    """Rows of both sides of a block grid, grouped by block pair (``_i``, ``_j``).

    Both sides have the same columns; ``_side`` tells them apart inside a group. Vectors of different widths
    have no similarity and never share a group.
    """
    return (left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
            .groupBy("_i", "_j", F.size("embedding").alias("_width")))


def _triangle(df: DataFrame, blocks: int):
    """The upper triangle of the block grid of a table with itself, diagonal included."""
    own = df.withColumn("_b", _block_of(blocks))
    left = own.withColumn("_j", F.explode(F.sequence("_b", F.lit(blocks - 1)))).withColumnRenamed("_b", "_i")
    right = own.withColumn("_i", F.explode(F.sequence(F.lit(0), "_b"))).withColumnRenamed("_b", "_j")
    return _pair_blocks(left, right)


def _rectangle(a: DataFrame, b: DataFrame, a_blocks: int, b_blocks: int):
    """Every block of ``a`` with every block of ``b``."""
    left = a.withColumn("_i", _block_of(a_blocks)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1))))
    right = b.withColumn("_j", _block_of(b_blocks)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
    return _pair_blocks(left, right)


def _side(table: pa.Table, side: int) -> pa.Table:
    return table.filter(pc.equal(table["_side"], side)).combine_chunks()


def _unit_of(table: pa.Table) -> np.ndarray:
    return unit_rows(matrix_of(table["embedding"].combine_chunks()))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def match_many(queries: DataFrame, thoughts: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """The ``k`` best thoughts for every query: ``query_id, id, similarity, rank``.

    ``queries``: ``id, embedding``. A query set of one block at most travels to every task, which
    scores its rows against all queries at once and passes on at most ``k`` rows per query. A larger
    one is cut into blocks and meets the blocks of thoughts on a grid, so that a task never holds more
    than two blocks and their best rows; the result is the same.
    """
    asked, rows = usable_vectors(queries), usable_vectors(thoughts)
    width, n = _width(asked), asked.count()
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType),
                           T.StructField("id", thoughts.schema["id"].dataType),
                           T.StructField("similarity", T.DoubleType())])
    id_types = to_arrow_schema(schema)
    if n <= BLOCK_ROWS and n * width * 8 <= BROADCAST_BYTES:
        block = asked.toArrow()  # one block
        sizes = pc.list_value_length(block["embedding"])
        asked_by_width = {w: block.filter(pc.equal(sizes, w)) for w in pc.unique(sizes).to_pylist()}
        sides = {w: (_numbers(part, "id")[0], _unit_of(part)) for w, part in asked_by_width.items()}

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                for width, (ids, q) in sides.items():  # other widths have no similarity
                    own = batch.filter(pc.equal(pc.list_value_length(batch["embedding"]), width))
                    if own.num_rows:
                        found = _best(q, ids, unit_rows(matrix_of(own["embedding"])),
                                      own["id"].to_numpy(zero_copy_only=False), threshold, k)
                        best = found if best is None else _keep(pd.concat([best, found]), k)
            if best is not None and len(best):
                yield pa.RecordBatch.from_pandas(best, schema=id_types, preserve_index=False)

        found = rows.mapInArrow(local, schema)
    else:
        grid = _rectangle(asked, rows, _block_count(n, width), _block_count(rows.count(), width))

        def pair(table: pa.Table) -> pa.Table:
            a, b = _side(table, 0), _side(table, 1)
            if not a.num_rows or not b.num_rows:
                return _empty(id_types)
            best = _best(_unit_of(a), _numbers(a, "id")[0], _unit_of(b), _numbers(b, "id")[0], threshold, k)
            return pa.Table.from_pandas(best, schema=id_types, preserve_index=False)

        found = grid.applyInArrow(pair, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _step(columns: int) -> int:
    """Rows of a tile with so many columns."""
    return max(1, _TILE * _TILE // max(1, columns))


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def _keep(df: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = df.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _best(queries: np.ndarray, query_ids, rows: np.ndarray, ids, threshold: float, k: int) -> pd.DataFrame:
    """The ``k`` best rows of every query, in tiles of bounded memory; ties at the end go by id."""
    found = []
    step = _step(len(rows))
    for at in range(0, len(queries), step):
        sims = queries[at:at + step] @ rows.T
        good = sims > threshold
        if k < len(rows):
            last = -np.partition(-np.nan_to_num(sims, nan=-np.inf), k - 1, axis=1)[:, k - 1]
            good &= sims >= last[:, None]
        qi, ti = np.nonzero(good)
        found.append(_keep(pd.DataFrame({"query_id": query_ids[at + qi], "id": ids[ti],
                                         "similarity": sims[qi, ti]}), k))
    if not found:
        return pd.DataFrame({"query_id": query_ids[:0], "id": ids[:0], "similarity": np.zeros(0)})
    return pd.concat(found, ignore_index=True)


def vector_key(c) -> Column:
    """16-byte digest of a vector's numbers: equal vectors, equal keys; joins on it move no vectors."""

    @F.arrow_udf("binary")
    def digest(v: pa.Array) -> pa.Array:
        keys = []
        for row in v:
            numbers = np.asarray(row.values.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0  # -0.0 is 0.0
            keys.append(hashlib.blake2b(numbers.tobytes(), digest_size=16).digest())
        return pa.array(keys, type=pa.binary())

    return digest(F.col(c) if isinstance(c, str) else c)


def vector_copies(thoughts: DataFrame) -> DataFrame:
    """Thoughts with the representative of their exact vector: ``id, representative``.

    The representative is the smallest id that holds the same vector.
    """
    keyed = usable_vectors(thoughts).select("id", vector_key("embedding").alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("id").alias("representative"))
    return keyed.join(first, "_key").select("id", "representative")


def similar_pairs(thoughts: DataFrame, threshold: float = DEFAULT_THRESHOLD, cross_day: bool = True,
                  start=None, end=None) -> DataFrame:
    """Pairs of thoughts more similar than ``threshold``: ``id_a < id_b, copies_a, copies_b,
    similarity``. With ``cross_day`` only pairs captured on different days;
    an unknown day differs from none.

    ``start`` and ``end`` narrow to a window (the weekly review looks at a week); the comparison is
    exact and its work grows with the square of the thoughts in it.

    Thoughts holding exactly the same vector stand as one, named by their smallest id with the number
    of copies (``vector_copies`` lists the members): a vector repeated a million times would
    otherwise alone give half a trillion rows. A pair counts as cross-day when some of its members are
    from different days, and copies from different days are themselves reported as a pair
    (``id_a = id_b``). Nothing is dropped: expanding both sides with ``vector_copies`` gives every
    pair.
    """
    groups = distinct_vectors(thoughts, start, end)
    n, width = groups.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = _pair_blocks_of(n, width or 1)
    rows = groups.where("id IS NOT NULL").withColumn("width", F.size("embedding")).withColumn("block", _block_of(blocks))
    schema = pairs_schema(thoughts)
    arrow = to_arrow_schema(schema)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, low, high = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches))
        numbers, (block, *facts) = numbers_of(table, width), _numbers(table, "block", *PAIR_FACTS)
        a, b = np.nonzero(block == low)[0], np.nonzero(block == high)[0]
        for i, j, s in places_above(numbers, a, b, threshold, low == high):
            yield from pair_rows(facts, i, j, s, cross_day, arrow)

    pairs = with_partners(rows, F.lit(blocks)).groupBy("width", "low", "high").applyInArrow(meet, schema)
    return pairs.unionByName(pairs_of_copies(groups, threshold, cross_day))


def pair_block_rows(width: int, most: int) -> int:
    """Vectors of a block of ``most`` at most."""
    return max(1, min(most, PAIR_BYTES // (8 * max(1, width))))


def _pair_blocks_of(n: int, width: int) -> int:
    return max(1, math.ceil(n / pair_block_rows(width, PAIR_ROWS)), min(PAIR_BLOCKS, math.ceil(n / BLOCK_ROWS)))


def with_partners(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with a ``block`` of so many, once for each pair of blocks that it is in: with ``low, high``."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_vectors(thoughts: DataFrame, start=None, end=None) -> DataFrame:
    """Each usable vector of a window once, written: ``embedding, id, copies, first_day, last_day``, with the smallest id that holds
    it and days as numbers."""
    on = F.to_date("created_at").alias("day") if "created_at" in thoughts.columns else F.lit(None).cast("date").alias("day")
    return written(usable_vectors(_window(thoughts, start, end), on).groupBy("embedding").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.unix_date(F.min("day")).alias("first_day"),
        F.unix_date(F.max("day")).alias("last_day")), "vectors")


def pairs_schema(thoughts: DataFrame) -> T.StructType:
    id_type = thoughts.schema["id"].dataType
    return T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("copies_a", T.LongType()),
                         T.StructField("copies_b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def pairs_of_copies(groups: DataFrame, threshold: float, cross_day: bool) -> DataFrame:
    """The pairs that copies of one vector make, one row for each vector."""
    same = groups.where("copies > 1" if threshold < 1.0 else "false")
    if cross_day:
        same = same.where("first_day <> last_day")
    return same.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.col("copies").alias("copies_a"),
                       F.col("copies").alias("copies_b"), F.lit(1.0).alias("similarity"))


PAIR_FACTS = ("id", "copies", "first_day", "last_day")


def numbers_of(table: pa.Table, width: int) -> np.ndarray:
    """Vectors of one width as the rows of a matrix, in their own type."""
    return table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def places_above(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float,
                 same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``a`` and rows ``b`` of ``numbers`` more similar than the threshold, in parts of bounded memory; where both sides are the
    ``same``, each pair once. Doubles are made of a tile at a time."""
    down, across, most = _TILE, max(1, _TILE // 4), max(1, _TILE * _TILE // 16)
    unit = lambda rows: unit_rows(numbers[rows].astype(np.float64, copy=False))
    found, held = [], 0
    for at in range(0, len(a), down):
        x = unit(a[at:at + down])
        for begin in range(at if same else 0, len(b), across):
            sims = x @ unit(b[begin:begin + across]).T
            place = np.flatnonzero(sims > threshold)
            r, c = np.divmod(place, sims.shape[1])
            r, c = r + at, c + begin
            if same and begin < at + down:
                place, r, c = place[c > r], r[c > r], c[c > r]
            if len(place):
                found.append((a[r], b[c], sims.ravel()[place]))
                held += len(place)
            if held >= most:
                yield tuple(map(np.concatenate, zip(*found)))
                found, held = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def pair_rows(facts: list[np.ndarray], i: np.ndarray, j: np.ndarray, s: np.ndarray, cross_day: bool,
              schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``pairs_schema`` for rows ``i`` and ``j``, if any. Facts: ids, copies, first and last days."""
    (ia, na, from_a, to_a), (ib, nb, from_b, to_b) = ([of[i] for of in facts], [of[j] for of in facts])
    keep = ia != ib
    if cross_day:
        known = np.isfinite(from_a.astype(float)) & np.isfinite(from_b.astype(float))
        keep &= known & ~((from_a == to_a) & (from_b == to_b) & (from_a == from_b))
    if keep.any():
        ia, ib, na, nb = ia[keep], ib[keep], na[keep], nb[keep]
        swap = ia > ib
        sides = np.where(swap, ib, ia), np.where(swap, ia, ib), np.where(swap, nb, na), np.where(swap, na, nb), s[keep]
        yield pa.RecordBatch.from_arrays([pa.array(part, f.type) for part, f in zip(sides, schema)], schema=schema)


def _window(thoughts: DataFrame, start, end) -> DataFrame:
    if start is not None:
        thoughts = thoughts.where(F.col("created_at") >= moment(start))
    if end is not None:
        thoughts = thoughts.where(F.col("created_at") < moment(end))
    return thoughts


def novelty(thoughts: DataFrame, start=None, end=None, n: int | None = 3) -> DataFrame:
    """The ``n`` most unusual thoughts of a window (all of them with ``n=None``): ``id, novelty``.

    Novelty is one minus the highest similarity to any other thought of the window; a thought that is
    alone has novelty 1. Each block pair reports one maximum per thought, so the result of the grid
    grows with the thoughts times the number of blocks, not with the pairs.
    """
    vectors = usable_vectors(_window(thoughts, start, end))
    schema = T.StructType([T.StructField("id", thoughts.schema["id"].dataType), T.StructField("nearest", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    # Exact copies have a neighbour at similarity 1; one representative per vector is enough.
    groups = vectors.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    grid = _triangle(groups.select("id", "embedding"), _block_count(groups.count(), _width(vectors)))

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = _side(table, 0), _side(table, 1)
        if not a.num_rows or not b.num_rows:
            return _empty(arrow)
        x, y = _unit_of(a), _unit_of(b)
        (ia,), (ib,) = _numbers(a, "id"), _numbers(b, "id")
        best = np.concatenate(_highest(x, y, ia, ib, key[0].as_py() == key[1].as_py()))
        real = np.isfinite(best)
        ids = pa.concat_arrays([a["id"].combine_chunks(), b["id"].combine_chunks()]).filter(pa.array(real))
        return pa.Table.from_arrays([ids, pa.array(best[real])], schema=arrow)

    nearest = grid.applyInArrow(pair, schema)
    best = nearest.groupBy("id").agg(F.max("nearest").alias("nearest"))
    lone = groups.select("id", vector_key("embedding").alias("_key"), "copies").join(best, "id", "left").select(
        "_key", F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("nearest")).alias("nearest"))
    ranked = vectors.select("id", vector_key("embedding").alias("_key")).join(lone, "_key").select(
        "id", (1 - F.coalesce("nearest", F.lit(0.0))).alias("novelty"))
    return ranked if n is None else ranked.orderBy(F.col("novelty").desc(), F.col("id").asc()).limit(n)


def _highest(x: np.ndarray, y: np.ndarray, ia, ib, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """The highest similarity of each row of ``x`` and of each row of ``y``, in tiles of bounded memory; on the diagonal a row
    does not meet itself."""
    across, down, step = np.full(len(ia), -np.inf), np.full(len(ib), -np.inf), _step(len(ib))
    for at in range(0, len(ia), step):
        sims = x[at:at + step] @ y.T
        if diagonal:
            sims[ia[at:at + step, None] == ib[None, :]] = -np.inf
        across[at:at + step] = sims.max(axis=1)
        np.maximum(down, sims.max(axis=0), out=down)
    return across, down


def chunk_documents(docs: DataFrame, max_chars: int = 800) -> DataFrame:
    """Documents cut into chunks: ``doc_id, position, content``."""
    return docs.select(F.col("id").alias("doc_id"),
                       F.posexplode(chunk_array("content", max_chars)).alias("position", "content"))


def match_documents(docs: DataFrame, chunks: DataFrame, query_vec, predicate: Column | None = None,
                    threshold: float = DEFAULT_THRESHOLD, k: int = DEFAULT_COUNT) -> DataFrame:
    """The ``k`` best documents by their best chunk, among documents that satisfy ``predicate``.

    ``docs``: ``id, …``; ``chunks``: ``doc_id, position, embedding``. Documents are filtered first, so only chunks
    of those that may count are scored, once each, and reduced to one row per document.
    """
    kept = docs if predicate is None else docs.where(predicate)
    mine = chunks.where(F.col("embedding").isNotNull()).join(kept.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    scored = mine.select("doc_id", "position", similarity_to("embedding", query_vec, once=True).alias("similarity"))
    found = (scored.where(F.col("similarity") > threshold).groupBy("doc_id")
             .agg(F.max("similarity").alias("similarity"),
                  F.min_by("position", F.struct((-F.col("similarity")).alias("s"), "position")).alias("position"))
             .select("doc_id", "position", "similarity"))
    return found.orderBy(F.col("similarity").desc(), F.col("doc_id").asc()).limit(k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact answer that the approximate one found."""
    hits = exact.select("id").join(approximate.select("id", F.lit(1).alias("hit")), "id", "left")
    return hits.agg(F.count("*").alias("expected"), F.count("hit").alias("found"),
                    F.try_divide(F.count("hit"), F.count("*")).alias("recall"))
