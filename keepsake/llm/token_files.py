"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import whole

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
KNOWN_PRETOKENS = 400_000
CHUNK_CHARS = 1_000_000
ENCODE_AT_ONCE = 2_000

# Below U+0250 these are all letters, numbers and white space.
LATIN = {"\\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
         "\\s": " \t\n\x0b\x0c\r\x85\xa0"}
BEYOND_LATIN = re.compile("[^\0-\u024f]")


def latin_pattern(pattern: str) -> str:
    """The same pattern with its classes spelled out for texts below U+0250, for the faster regex module."""
    inside = re.compile(r"\[[^\]]*\]")
    spelled = inside.sub(lambda m: _replaced(m[0], "{}"), pattern)
    kept = inside.findall(spelled)
    rest = iter(kept)
    outside = "".join(_replaced(part, "[{}]").replace("\\S", f"[^{LATIN['\\s']}]") + next(rest, "")
                      for part in inside.split(spelled))
    return outside


def _replaced(text: str, form: str) -> str:
    for name, members in LATIN.items():
        text = text.replace(name, form.format(members))
    return text


class PretokenEncoder:
    """Encodes texts with the tokenizers library, one distinct pre-token at a time.

    A byte-level vocabulary splits a text into pre-tokens (``pattern``) before merging, and merges never cross
    them. So each distinct pre-token is given to the library once and the ids are joined; the result is that of
    encoding the whole text. A text that holds the string of a special token goes to the library whole. At
    ``limit`` entries a new table is begun; the one before it serves until the next is full, so what is frequent stays
    and memory is bounded.
    """

    def __init__(self, path: str, pattern: str, limit: int = KNOWN_PRETOKENS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_pattern(pattern)).findall
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        if any(s in text for s in self.specials):
            return [text]
        return self.split(text) if BEYOND_LATIN.search(text) else self.split_latin(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        rows, new = [], {}
        for text in texts:
            words = self.pretokens(text)
            parts = list(map(known.get, words))
            holes, at = [], -1
            try:
                while True:
                    at = parts.index(None, at + 1)
                    holes.append((at, words[at]))
            except ValueError:
                for _, word in holes:
                    if word in older:
                        known[word] = older[word]
                    else:
                        new[word] = None
                rows.append((parts, holes))
        new = list(new)
        for i in range(0, len(new), ENCODE_AT_ONCE):
            some = new[i:i + ENCODE_AT_ONCE]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        out = []
        for parts, holes in rows:
            for at, word in holes:
                parts[at] = known[word]
            out.append(b"".join(parts))
        for text in texts:  # whole texts are not kept
            if any(s in text for s in self.specials):
                known.pop(text, None)
        return out


_ENCODERS: dict[tuple[str, str], PretokenEncoder] = {}  # of this Python worker: what it knows serves its later tasks


def _encoder(path: str, pattern: str, limit: int) -> PretokenEncoder:
    if (path, pattern) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, pattern] = PretokenEncoder(path, pattern)
    _ENCODERS[path, pattern].limit = limit
    return _ENCODERS[path, pattern]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode_batches(tokenizer_path: str, pattern: str, end_id: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path, pattern, known), np.array([end_id], dtype="<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                ids = [x + end for x in encoder.encode(texts[a:b])]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, dtype=np.int32)),
                    pa.array(at + ends - counts), pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, values)],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 2, row_index_stride: int = 1000,
                 stripe_bytes: int = 16 << 20, bloom_fpp: float = 0.01, known: int = KNOWN_PRETOKENS) -> None:
    """Encode every whole text, append ``end_id`` and write the ids as ORC files in ascending doc_id order.

    ``pattern`` is the vocabulary's pre-token pattern. ``known`` bounds the memory of a worker: it remembers the ids of twice as
    many pre-tokens at most (about 250 bytes each). The result doesn't depend on it.

    Rows are range partitioned by doc_id (ties by a hash of the text, null ids last), so file after file and row
    after row ids ascend; each row also has the number of ids before it in its file. Integer columns, the ids
    among them, use ORC's run-length encoding; ``doc_id`` has row indexes every ``row_index_stride`` rows and
    Bloom filters, so readers skip stripes and row groups. A stripe is the unit of parallel reading.

    A null text is an empty one: its row holds the end id alone. Repeated rows are all written. An empty table
    gives files without rows. Other columns are not written.
    """
    ordered = (docs.select("doc_id", whole().alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")))
    (ordered.mapInArrow(_encode_batches(tokenizer_path, pattern, end_id, known), FILE_SCHEMA)
     .write.option("compression", "zstd").option("orc.create.index", "true")
     .option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes))
     .option("orc.rows.between.memory.checks", str(row_index_stride))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``, the number of ids of all documents before. Filters on ``doc_id``
    reach the files' statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows.join(file_starts(spark, path), "part").withColumn("start", F.col("before") + F.col("part_start")).drop(
        "before")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``before``: the ids in all files before each file. One row per file."""
    from pyspark.sql import Window

    ends = (spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part")
            .agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return ends.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        ends = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        kept = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(sums, type=pa.int64())],
            names=[*(batch.schema.names[i] for i in kept), "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files. The ids end in their checksums where they are read;
    only those meet the files' starts."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "part", "part_start", F.col("n_tokens").cast("long"), "ids")
    sums = rows.mapInArrow(_checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return sums.join(file_starts(spark, path), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
