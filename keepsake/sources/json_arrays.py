"""Large JSON arrays read by many tasks: files in byte ranges, archives by member, cut at the commas between elements.

Text is read in pieces that end before a ``}``. Pieces of one byte range are joined to chunks, and each chunk is
measured twice, as if it began outside a string and as if it began inside one. Running sums over these measures, a few
numbers per chunk, tell where each chunk really begins; then every chunk is cut alone, and only elements that cross a
border of chunks are shuffled.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.session import fresh_path

CHUNK_BYTES = 1 << 20

_MEASURE = "quotes int, rise array<int>, commas array<map<int,bigint>>"
_CHUNKS = f"file string, block bigint, no int, shown bigint, opens boolean, closes boolean, {_MEASURE}, body binary"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("no", pa.int32()), ("shown", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()),
    ("quotes", pa.int32()), ("rise", pa.list_(pa.int32())), ("commas", pa.list_(pa.map_(pa.int32(), pa.int64()))), ("body", pa.binary())])


def _structure(body: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Depth after each byte, from 0, and the places of commas outside strings. Escapes must be whole within ``body``."""
    plain = np.frombuffer(re.sub(rb"\\.", b"__", body, flags=re.DOTALL), np.uint8)
    quoted = np.logical_xor.accumulate(plain == ord('"')) if len(plain) else np.zeros(0, bool)
    outside = ~(quoted ^ inside)
    step = ((plain == ord("{")) | (plain == ord("["))).astype(np.int32) - ((plain == ord("}")) | (plain == ord("]")))
    return np.cumsum(step * outside), np.flatnonzero((plain == ord(",")) & outside)


def _measured(body: bytes) -> dict:
    """Characters that show, quotes, and for a start outside and inside a string: rise in depth, commas by the depth they are at."""
    rise, commas = [], []
    for inside in (False, True):
        depth, at = _structure(body, inside)
        rise.append(int(depth[-1]) if len(depth) else 0)
        commas.append(list(zip(*(x.tolist() for x in np.unique(depth[at], return_counts=True)))))
    quotes = re.sub(rb"\\.", b"", body, flags=re.DOTALL).count(b'"')
    seen = body.removeprefix("﻿".encode()).strip(b" \t\r\n")
    shown = len(re.sub(rb"[ \t\r\n]+", b"", seen))
    return {"shown": shown, "opens": seen.startswith(b"["), "closes": seen.endswith(b"]"), "quotes": quotes % 2, "rise": rise, "commas": commas}


def _batch(file: str, block: int, no: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"file": file, "block": block, "no": no, "body": body, **_measured(body)}], _SCHEMA)


def _joined(size: int):
    """Pieces ``file, block, value`` in the order of the file to chunks of at least ``size`` bytes, one batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, held = None, 0, bytearray()
        for batch in batches:
            for file, block, value in zip(*(column.to_pylist() for column in batch.columns)):
                if (file, block) != key:
                    if held:
                        yield _batch(*key, no, bytes(held))
                    key, no, held, first = (file, block), 0, bytearray(), block == 0
                # The } that ended the piece before, which may be in another range.
                held += value.encode() if first else b"}" + value.encode()
                first = False
                if len(held) >= size:
                    yield _batch(*key, no, bytes(held))
                    no, held = no + 1, bytearray()
        if held:
            yield _batch(*key, no, bytes(held))

    return run


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, if pyarrow knows it, and the path within."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _opened(path: str):
    """A file for reading in any order."""
    system, name = located(path)
    return system.open_input_file(name)


def _members(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as source, zipfile.ZipFile(source) as archive:
                    names = [n for n in archive.namelist() if re.search(pattern, n)]
                yield pa.RecordBatch.from_pydict({"path": [path] * len(names), "name": names}, pa.schema([("path", pa.string()), ("name", pa.string())]))

    return run


def _unpacked(size: int):
    """Members ``path, name`` to chunks that end after a ``}``; a member is inflated piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(*(column.to_pylist() for column in batch.columns)):
                with _opened(path) as source, zipfile.ZipFile(source) as archive, archive.open(name) as member:
                    no, held, more = 0, b"", True
                    while more:
                        piece = member.read(size)
                        more, held = bool(piece), held + piece
                        end = held.rfind(b"}") + 1 if more else len(held)
                        if end or not more:
                            yield _batch(f"{path}!{name}", 0, no, held[:end])
                            no, held = no + 1, held[end:]

    return run


def file_chunks(spark: SparkSession, path: str, glob: str, pattern: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the files in ``path`` whose names match ``glob`` and ``pattern``, read in byte ranges."""
    pieces = (spark.read.option("pathGlobFilter", glob).option("lineSep", "}").text(path)
              .where(F.col("_metadata.file_name").rlike(pattern))
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    return pieces.mapInArrow(_joined(size), _CHUNKS)


def archive_chunks(spark: SparkSession, path: str, pattern: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the members of zip archives whose names match ``pattern``, a member to a task.

    Only the directory of an archive is read to list its members. The archives must be on a file system that pyarrow
    opens (local, HDFS, S3, GCS).
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    members = paths.mapInArrow(_members(pattern), "path string, name string")
    return members.repartition("path", "name").mapInArrow(_unpacked(size), _CHUNKS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of chunks ``file, block, no, inside, depth, ordinal, body`` between commas at depth 1."""
    for batch in batches:
        for row in batch.to_pylist():
            depth, at = _structure(row["body"], row["inside"])
            cuts = at[depth[at] + row["depth"] == 1] if len(at) else at
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(row["body"])]
            # A border within a character of several bytes can't occur: chunks and cuts lie at ASCII characters.
            texts = [row["body"][a:b].decode("utf-8") for a, b in zip(starts, ends)]
            n = len(texts)
            yield pa.RecordBatch.from_pydict({
                "file": [row["file"]] * n, "position": [row["ordinal"] + i for i in range(n)], "block": [row["block"]] * n,
                "no": [row["no"]] * n, "whole": [0 < i < n - 1 for i in range(n)], "raw": texts},
                pa.schema([("file", pa.string()), ("position", pa.int64()), ("block", pa.int64()), ("no", pa.int32()),
                           ("whole", pa.bool_()), ("raw", pa.string())]))


def array_elements(chunks: DataFrame, label: str = "array") -> tuple[DataFrame, DataFrame]:
    """Elements of the JSON arrays given as chunks: ``file, position, raw``, and one row per file: ``file, elements, state``.

    ``state`` is ``read``, ``not an array`` (skipped; also a file without text) or ``malformed``; reading the elements of a malformed
    file fails. ``raw`` is the text of the element as it stands in the file. The chunks are written once to the shared folder, so that
    both passes see the same borders; a file that is read again gives the same rows.
    """
    spark, path = chunks.sparkSession, fresh_path(chunks.sparkSession, label)
    chunks.write.parquet(path)
    stored = spark.read.parquet(path)

    upto = Window.partitionBy("file").orderBy("block", "no")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    way = F.col("inside").cast("int")
    # An element's chunk knows its commas at every depth; those of depth 1 separate elements.
    placed = (stored.drop("body")
              .withColumn("inside", inside == 1)
              .withColumn("up", F.get("rise", way))
              .withColumn("depth", F.coalesce(F.sum("up").over(before), F.lit(0)).cast("int"))
              .withColumn("n", F.coalesce(F.try_element_at(F.get("commas", way), 1 - F.col("depth")), F.lit(0)))
              .withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # The first and last chunk with text decide, whatever blank chunks are around them.
    told = F.when(F.col("shown") > 0, F.struct("block", "no", "opens", "closes"))
    files = placed.groupBy("file").agg(
        F.coalesce(F.min(told)["opens"], F.lit(False)).alias("opens"), F.max(told)["closes"].alias("closes"), F.sum("up").alias("depth"),
        (F.sum("quotes") % 2).alias("open_string"), F.sum("n").alias("commas"), F.sum("shown").alias("shown"))
    broken = ~F.col("closes") | (F.col("depth") != 0) | (F.col("open_string") != 0)
    files = files.select(
        "file", F.when(~F.col("opens"), "not an array").when(broken, "malformed").otherwise("read").alias("state"), "commas",
        ((F.col("commas") == 0) & (F.col("shown") == 2)).alias("empty"))
    report = files.select("file", F.when((F.col("state") == "read") & ~F.col("empty"), F.col("commas") + 1).otherwise(0)
                          .cast("bigint").alias("elements"), "state")

    arrays = files.where("state = 'malformed' OR (state = 'read' AND NOT empty)").select("file", "state")
    failed = F.raise_error(F.concat(F.lit("malformed JSON array: "), F.col("file"))).cast("binary")
    starts = placed.join(arrays, "file").select("file", "block", "no", "inside", "depth", "ordinal", "state")
    parts = (stored.select("file", "block", "no", "body").join(starts, ["file", "block", "no"])
             .select("file", "block", "no", "inside", "depth", "ordinal", F.when(F.col("state") == "malformed", failed).otherwise(F.col("body")).alias("body"))
             .mapInArrow(_cut, "file string, position bigint, block bigint, no int, whole boolean, raw string"))
    # Parts at a chunk's borders go on in the next chunk, or are the ends of the array.
    crossing = (parts.where(~F.col("whole")).groupBy("file", "position")
                .agg(F.array_sort(F.collect_list(F.struct("block", "no", "raw"))).alias("parts"))
                .select("file", "position", F.array_join("parts.raw", "").alias("raw"))
                .join(files.select("file", "commas"), "file"))
    opened = F.when(F.col("position") == 0, F.regexp_replace("raw", r"^\x{FEFF}?[ \t\r\n]*\[", "")).otherwise(F.col("raw"))
    closed = F.when(F.col("position") == F.col("commas"), F.regexp_replace(opened, r"\][ \t\r\n]*$", "")).otherwise(opened)
    elements = crossing.select("file", "position", closed.alias("raw")).unionByName(parts.where("whole").select("file", "position", "raw"))
    return elements.withColumn("raw", F.trim("raw", F.lit(" \t\r\n"))), report
