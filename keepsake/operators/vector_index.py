"""A stored index over vectors: inverted lists around trained centres, residual codes, exact re-ranking.

Layout below one folder: ``rows`` (one folder per list: ``id, code, embedding``), ``centres``, ``books`` (code words of each slice
of the residual) and ``about`` (one row: width, default probes, and so on). A question reads the codes of some lists
only, and the vectors of few candidates.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsake.functions.vectors import matrix_of, similarity_to, unit_rows
from keepsake.operators.retrieval import DEFAULT_COUNT, DEFAULT_THRESHOLD, usable_vectors

MAX_LISTS = 4096
SAMPLE_ROWS = 40_000
SLICE = 4  # numbers of the residual per code byte
WORDS = 256
PART_ROWS = 50_000
OTHER_WIDTHS = -1  # the list of vectors whose width is not the index's
_TILE = 2048


@dataclass
class VectorIndex:
    """A stored index, opened: what a question needs on the driver (at most ``MAX_LISTS`` centres)."""
    path: str
    centres: np.ndarray
    books: np.ndarray  # slice x word x SLICE
    sizes: np.ndarray  # rows of each list
    probes: int
    id_type: str
    spread: int = 0  # candidates that ``DEFAULT_COUNT`` neighbours were measured to need

    def rows(self, spark: SparkSession) -> DataFrame:
        return _rows(spark, self.path, self.id_type)

    def candidates(self, k: int) -> int:
        """Candidates to score exactly for ``k`` neighbours, 20 for each at least."""
        return max(20 * k, -(-k * self.spread // DEFAULT_COUNT))


def _rows(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"id {id_type}, code binary, embedding array<float>, list int").parquet(os.path.join(path, "rows"))


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of largest inner product for each row, in tiles of bounded memory."""
    return np.concatenate([(unit[k:k + _TILE] @ centres.T).argmax(axis=1) for k in range(0, len(unit), _TILE)]
                          or [np.zeros(0, dtype=np.int64)])


def _directions(unit: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first rows are the first centres."""
    centres = unit[:lists].copy()
    for _ in range(rounds):
        own = _nearest(unit, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _sliced(residual: np.ndarray) -> np.ndarray:
    """Rows cut into slices of ``SLICE`` numbers, the last one filled up with zeros: slice x row x ``SLICE``."""
    filled = np.pad(residual, ((0, 0), (0, -residual.shape[1] % SLICE)))
    return filled.reshape(len(filled), -1, SLICE).transpose(1, 0, 2)


def _code_words(residual: np.ndarray, rounds: int) -> np.ndarray:
    """Code words of each slice by k-means."""
    books = []
    for part in _sliced(residual):
        words = part[:WORDS].copy()
        for _ in range(rounds):
            own = _closest(part, words)
            sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
            np.add.at(sums, own, part)
            words[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(words)
    return np.stack(books)


def _closest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words * words).sum(axis=1) / 2
    return np.concatenate([(points[k:k + _TILE] @ words.T - half).argmax(axis=1) for k in range(0, len(points), _TILE)])


def _coded(unit: np.ndarray, own: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.stack([_closest(part, words) for part, words in zip(_sliced(unit - centres[own]), books)], axis=1).astype(np.uint8)


def _places(sizes: np.ndarray, unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each list in the order in which each question reads them."""
    order = np.argsort(-np.where(sizes > 0, unit @ centres.T, -np.inf), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    return place


def _enough(needed: np.ndarray, share: float) -> int:
    """The least number that is enough for ``share`` of ``needed``."""
    return int(np.sort(needed)[max(0, int(np.ceil(share * len(needed))) - 1)])


def _measured(rows: DataFrame, sizes: np.ndarray, ids: np.ndarray, unit: np.ndarray, centres: np.ndarray, books: np.ndarray, recall: float,
              k: int = DEFAULT_COUNT) -> tuple[int, int]:
    """Lists to read and candidates to score that find ``recall`` of the ``k`` nearest neighbours of some questions, other rows of the
    index, compared with all of it: one scan finds the neighbours, one their ranks among the estimates of the lists read."""
    to_centre, tables = unit @ centres.T, np.stack([_tables(books, q) for q in unit])
    slices = np.arange(len(books))

    def estimates(q: int, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return to_centre[q, lists] + tables[q][slices, codes].sum(axis=1)

    def coded(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch["code"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, len(books))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, codes = batch["list"].to_numpy(), coded(batch)
            sims = unit @ unit_rows(matrix_of(batch["embedding"])).T
            sims[ids[:, None] == batch["id"].to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            best = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
            for q, at in enumerate(best):
                at = at[np.isfinite(sims[q, at])]
                yield pa.RecordBatch.from_pydict({"question": np.full(len(at), q, dtype=np.int32), "list": lists[at], "similarity": sims[q, at],
                                                  "estimate": estimates(q, lists[at], codes[at])})

    order = Window.partitionBy("question").orderBy(F.desc("similarity"), "list", "estimate")
    found = (rows.mapInArrow(near, "question int, list int, similarity double, estimate double")
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect())  # k for each question
    if not found:
        return 1, 0
    question, own, bound = (np.array([r[c] for r in found]) for c in ("question", "list", "estimate"))
    place = _places(sizes, unit, centres)
    needed = place[question, own] + 1
    probes = _enough(needed, (1 + recall) / 2)  # half of what may be missed is left to the candidates
    read = place < probes
    asked = [(q, np.nonzero((question == q) & (needed <= probes))[0]) for q in range(len(unit))]

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bound), dtype=np.int64)
        for batch in batches:
            lists, codes = batch["list"].to_numpy(), coded(batch)
            for q, at in asked:
                mine = read[q, lists]
                total[at] += (estimates(q, lists[mine], codes[mine])[:, None] > bound[at]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "n": total})

    rank = np.full(len(bound), np.iinfo(np.int64).max)
    counts = rows.select("list", "code").mapInArrow(above, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    for r in counts:  # one row for each neighbour
        if needed[r["at"]] <= probes:
            rank[r["at"]] = r["n"] + 1
    return probes, _enough(rank, recall)


def build_index(thoughts: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, sample_rows: int = SAMPLE_ROWS,
                rounds: int = 12, seed: int = 7, questions: int = 200) -> VectorIndex:
    """Index every usable vector (``id, embedding``) below ``path``.

    Centres (about the square root of the number of vectors, ``MAX_LISTS`` at most) and code words are trained on ``sample_rows``
    vectors of the commonest width, drawn by a hash of the id; every vector is put in its nearest centre's list. The number of
    lists that a question reads by default, and of candidates that it scores exactly, is measured: as many as find ``recall`` of the true
    neighbours of ``questions`` vectors that centres and code words were not trained on, by brute force over all rows. Vectors of other widths go to a list of their own, which is searched exactly. A large list is several files.

    Null, empty, zero and NaN vectors match nothing and are not stored. Repeated rows are all stored.
    """
    spark = thoughts.sparkSession
    rows = usable_vectors(thoughts)
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    width, n = (widths[0]["width"], widths[0]["n"]) if widths else (1, 0)
    drawn = rows.where(F.size("embedding") == width).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    sample = drawn.select("id", "embedding").toArrow().combine_chunks()  # at most sample_rows vectors
    unit = unit_rows(matrix_of(sample["embedding"].combine_chunks())) if len(sample) else np.zeros((0, width))
    apart = min(questions, len(unit) // 10)  # trained vectors lie nearer to their centres than others, which would flatter the measure
    asked_ids, asked = sample["id"].to_numpy()[len(unit) - (apart or len(unit)):], unit[len(unit) - (apart or len(unit)):]
    unit = unit[:len(unit) - apart]
    lists = max(1, min(lists or round(n ** 0.5), MAX_LISTS, len(unit)))
    centres = _directions(unit, lists, rounds) if len(unit) else np.zeros((1, width))
    books = _code_words(unit - centres[_nearest(unit, centres)], rounds) if len(unit) else np.zeros((-(-width // SLICE), 1, SLICE))
    id_type = thoughts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch["embedding"]), width)
            for part, known in ((batch.filter(fits), True), (batch.filter(pc.invert(fits)), False)):
                if not part.num_rows:
                    continue
                if known:
                    u = unit_rows(matrix_of(part["embedding"]))
                    own = _nearest(u, centres)
                    codes = pa.array([c.tobytes() for c in _coded(u, own, centres, books)], pa.binary())
                else:
                    own, codes = np.full(part.num_rows, OTHER_WIDTHS), pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(own.astype(np.int32)), codes, part["embedding"].cast(arrow.field(3).type)],
                                                 schema=arrow)

    (rows.mapInArrow(listed, schema).repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list")
     .write.mode("overwrite").partitionBy("list").parquet(os.path.join(path, "rows")))
    stored = _rows(spark, path, id_type.simpleString()).where(F.col("list") >= 0)
    probes, spread = _measured(stored, _sizes(stored, len(centres)), asked_ids, asked, centres, books, recall) if len(unit) else (1, 0)
    _store(spark, path, centres, books, probes, spread, id_type.simpleString())
    return open_index(spark, path)


def _sizes(rows: DataFrame, lists: int) -> np.ndarray:
    sizes = np.zeros(lists, dtype=np.int64)
    for r in rows.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    return sizes


def _store(spark: SparkSession, path: str, centres: np.ndarray, books: np.ndarray, probes: int, spread: int, id_type: str) -> None:
    def put(name: str, rows: list[tuple], schema: str) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))

    put("centres", [(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>")
    put("books", [(s, w, x.tolist()) for s, words in enumerate(books) for w, x in enumerate(words)], "slice int, word int, part array<double>")
    put("about", [(centres.shape[1], int(probes), id_type, int(spread))], "width int, probes int, id_type string, spread long")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index. Reads the centres, code words and list sizes, all of bounded number."""
    read = lambda name: spark.read.parquet(os.path.join(path, name))
    centres = np.array([r["centre"] for r in read("centres").orderBy("list").collect()])
    words = read("books").orderBy("slice", "word").collect()
    books = np.array([r["part"] for r in words]).reshape(words[-1]["slice"] + 1, -1, SLICE)
    about = read("about").first().asDict()
    sizes = _sizes(_rows(spark, path, about["id_type"]).where(F.col("list") >= 0), len(centres))
    return VectorIndex(path, centres, books, sizes, about["probes"], about["id_type"], about.get("spread", 0))


def _asked(query_vec) -> np.ndarray:
    q = np.asarray(query_vec, dtype=np.float64)
    length = np.sqrt(q @ q)
    return q / length if length > 0 else np.full_like(q, np.nan)


def _lists_of(index: VectorIndex, q: np.ndarray, probes: int | None) -> np.ndarray:
    """The lists to read for unit questions, nearest centre first; empty lists are never among them."""
    sims = np.where(index.sizes > 0, q @ index.centres.T, -np.inf)
    order = np.argsort(-sims, axis=-1, kind="stable")[..., :probes or index.probes]
    return np.where(np.take_along_axis(sims, order, axis=-1) > -np.inf, order, OTHER_WIDTHS)


def _tables(books: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of a unit question with every code word: slice x word."""
    return np.einsum("swk,sk->sw", books, _sliced(q[None, :])[:, 0, :])


def match_indexed(spark: SparkSession, index: VectorIndex, query_vec, k: int = DEFAULT_COUNT, threshold: float = DEFAULT_THRESHOLD,
                  probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """The ``k`` nearest of the vectors in the ``probes`` nearest lists: ``id, similarity``, best first, ties by id.

    The codes of these lists are read and scored, the ``candidates`` best (as measured for the index unless given) are fetched from the same lists
    and scored exactly. Only similarities above ``threshold`` count. Questions of another width than the index's are
    answered exactly from the list of other widths.
    """
    q, rows = _asked(query_vec), index.rows(spark)
    if len(q) != index.centres.shape[1]:
        near = rows.where(F.col("list") == OTHER_WIDTHS)
    else:
        wanted = [int(x) for x in _lists_of(index, q, probes) if x >= 0]
        lists = rows.where(F.col("list").isin(*wanted)) if wanted else rows.limit(0)
        to_centre, tables = index.centres @ q, _tables(index.books, q)

        @F.arrow_udf("double")
        def estimate(list_no: pa.Array, code: pa.Array) -> pa.Array:
            codes = np.frombuffer(b"".join(code.to_pylist()), dtype=np.uint8).reshape(len(code), len(tables))
            return pa.array(to_centre[list_no.to_numpy()] + tables[np.arange(len(tables)), codes].sum(axis=1))

        best = (lists.select("id", "list", estimate("list", "code").alias("estimate"))
                .orderBy(F.col("estimate").desc(), F.col("id").asc()).limit(candidates or index.candidates(k)).select("id", "list").distinct())
        near = lists.join(F.broadcast(best), ["list", "id"], "left_semi")  # at most ``candidates`` rows
    scored = near.select("id", similarity_to("embedding", q, once=True).alias("similarity"))
    return scored.where(F.col("similarity") > threshold).orderBy(F.col("similarity").desc(), F.col("id").asc()).limit(k)


def match_many_indexed(index: VectorIndex, queries: DataFrame, k: int = 5, threshold: float = DEFAULT_THRESHOLD,
                       probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """``match_indexed`` for a table of questions (``id, embedding``): ``query_id, id, similarity, rank``.

    Each question goes to its lists and meets their codes there; a list of more than ``PART_ROWS`` rows is divided into parts by id, so a
    group is bounded. A group keeps the ``candidates`` best of a question; the best over all groups are scored exactly.
    Questions of another width than the index's, or unusable ones, find nothing here.
    """
    spark, width = queries.sparkSession, index.centres.shape[1]
    candidates = candidates or index.candidates(k)
    asked = usable_vectors(queries).where(F.size("embedding") == width)
    query_type, id_type = queries.schema["id"].dataType, index.rows(spark).schema["id"].dataType
    parts = np.maximum(1, -(-index.sizes // PART_ROWS))
    to_lists = T.StructType([T.StructField("query_id", query_type), T.StructField("list", T.IntegerType()),
                             T.StructField("part", T.IntegerType()), T.StructField("unit", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(to_lists)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(matrix_of(batch["embedding"]))
            lists = _lists_of(index, unit, probes)
            row, at = np.nonzero(lists >= 0)
            list_no = lists[row, at]
            again = np.repeat(np.arange(len(row)), parts[list_no])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[list_no]) - parts[list_no], parts[list_no])
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(row[again])), pa.array(list_no[again].astype(np.int32)), pa.array(part.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(again) + 1, dtype=np.int32) * width), pa.array(unit[row[again]].ravel()))],
                schema=arrow)

    number = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1) if parts.max() > 1 else F.lit(1)
    codes = index.rows(spark).where(F.col("list") >= 0).select("id", "list", "code", F.pmod(F.xxhash64("id"), number).cast("int").alias("part"))
    found = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("list", T.IntegerType()),
                          T.StructField("estimate", T.DoubleType())])
    found_arrow = to_arrow_schema(found)

    def scored(key: tuple[pa.Scalar, ...], questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not questions.num_rows or not rows.num_rows:
            return found_arrow.empty_table()
        rows = rows.sort_by("id")  # equal estimates, of copies for instance, go by id
        data = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, len(index.books))
        ids, asked_ids = rows["id"].combine_chunks(), questions["query_id"].combine_chunks()
        unit = matrix_of(questions["unit"].combine_chunks())
        out = []
        for row, q in enumerate(unit):
            estimate = index.centres[key[0].as_py()] @ q + _tables(index.books, q)[np.arange(len(index.books)), data].sum(axis=1)
            best = np.argsort(-estimate, kind="stable")[:candidates]
            out.append(pa.Table.from_arrays([pa.array([asked_ids[row].as_py()] * len(best), found_arrow.field(0).type), ids.take(pa.array(best)),
                                             pa.array(np.full(len(best), key[0].as_py(), dtype=np.int32)), pa.array(estimate[best])],
                                            schema=found_arrow))
        return pa.concat_tables(out)

    lists = asked.mapInArrow(spread, to_lists)
    near = lists.groupBy("list", "part").cogroup(codes.groupBy("list", "part")).applyInArrow(scored, found)
    by_estimate = Window.partitionBy("query_id").orderBy(F.col("estimate").desc(), F.col("id").asc())
    near = near.withColumn("_n", F.row_number().over(by_estimate)).where(F.col("_n") <= candidates).select("query_id", "id", "list").distinct()
    rows = index.rows(spark).select("id", "list", "embedding")
    pairs = near.join(rows, ["list", "id"]).join(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")

    @F.arrow_udf("double")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", unit_rows(matrix_of(a)), unit_rows(matrix_of(b))) if len(a) else np.zeros(0))

    scores = pairs.select("query_id", "id", exact("asked", "embedding").alias("similarity")).where(F.col("similarity") > threshold)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
