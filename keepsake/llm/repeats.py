"""Repeated byte strings across a corpus, by a sparse suffix array sorted deep-shallow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import whole, written
from keepsake.llm.hashing import mixed, text_chunks
from keepsake.llm.suffix_order import deep_shallow

GRAM = 16  # bytes of an anchor
PIECE_CHARS, COMBINED_ANCHORS = 1_000_000, 400_000
BATCH_RECORDS = 50_000
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
DOC = "doc long, version long"
RECORDS = f"gram long, context long, {DOC}, low long, high long, anchor long, mark boolean"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ODD))])
        _POWERS["down"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ODD_INVERSE))])
    return _POWERS["up"], _POWERS["down"]


def anchors(parts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The anchors of byte strings, and the starts of ``length``-byte windows each one serves.

    A window's anchor is the 16-byte gram with the least hash in it, of equals the last. It depends on the
    window's bytes alone, so equal windows have equal anchors at equal distances. Arrays: ``part``, ``low`` and
    ``high`` (first and last window start), ``anchor`` (place in the part), ``gram`` (hash), ``context`` (hash of all
    bytes of those windows).
    """
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    names = ("part", "low", "high", "anchor", "gram", "context")
    if len(data) < length:
        return {k: np.zeros(0, dtype=np.int64) for k in names}
    value = _BYTES[data]
    h, width = value, 1
    while width < GRAM:
        h = mixed(h[:-width] * _ODD + (h[width:] ^ np.uint64(width * 0x1234567)))
        width *= 2
    least, at, span, reach = h, np.arange(len(h)), length - GRAM + 1, 1

    def narrower(first, second):
        take = least[second] <= least[first]
        return np.where(take, least[second], least[first]), np.where(take, at[second], at[first])

    while reach * 2 <= span:
        least, at = narrower(slice(None, -reach), slice(reach, None))
        reach *= 2
    if reach < span:
        least, at = narrower(slice(None, len(least) - (span - reach)), slice(span - reach, None))
    part = np.repeat(np.arange(len(parts)), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))[:-1]])
    start = np.arange(len(part)) - first[part] + (ends - sizes)[part]
    if not len(start):
        return {k: np.zeros(0, dtype=np.int64) for k in names}
    own = at[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(part) != 0)]))
    last = np.concatenate([new[1:] - 1, [len(own) - 1]])
    low, high, anchor, part = start[new], start[last], own[new], part[new]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:len(value)])])
    context = mixed((sums[high + length] - sums[low]) * down[low]
                    + ((anchor - low) * 1009 + (high - low)).astype(np.uint64) * _ODD)
    base = (ends - sizes)[part]
    return {"part": part, "low": low - base, "high": high - base, "anchor": anchor - base,
            "gram": h[anchor].view(np.int64), "context": context.view(np.int64)}


def _combined(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of records with equal contexts the earliest goes on; the others' windows are repeats already."""
    order = np.lexsort((found["low"], found["version"], found["doc"], found["context"], found["gram"]))
    found = {k: v[order] for k, v in found.items()}
    equal = lambda *names: np.concatenate([[False], np.logical_and.reduce(
        [found[k][1:] == found[k][:-1] for k in names])]) if len(order) else np.zeros(0, dtype=bool)
    again = equal("gram", "context")
    kept = ~equal("gram", "context", "doc", "version", "low")  # the same place of a repeated row
    # A row alike the first of its run in place too was dropped above, so what follows a first is later.
    spread = mixed((found["doc"] ^ (found["low"] * 7919)).view(np.uint64)).view(np.int64)
    columns = [np.where(again, spread, found["gram"]), np.where(again, spread, found["context"]),
               *(found[k] for k in ("doc", "version", "low", "high", "anchor")), again]
    return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=[c.split()[0] for c in RECORDS.split(", ")])


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def joined():
            return _combined({k: np.concatenate([f[k] for f in held]) for k in held[0]})

        for batch in batches:
            texts = batch.column(2).to_pylist()
            doc, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in text_chunks(texts, PIECE_CHARS):
                found = anchors([t.encode("utf-8", "surrogatepass") for t in texts[a:b]], length)
                found["doc"], found["version"] = doc[a:b][found["part"]], version[a:b][found["part"]]
                held.append({k: v for k, v in found.items() if k != "part"})
                count += len(found["part"])
                if count >= COMBINED_ANCHORS:
                    yield joined()
                    held, count = [], 0
        if held:
            yield joined()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: they cross the network twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        text = [pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.binary())], names=[*batch.schema.names[:-1], "packed"])


def _unpacked(packed: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    for x in packed:
        yield unpack(x.as_py())


CONTEXTS = f"gram long, {DOC}, low long, high long, anchor long, bytes binary"


def _context_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, version, places, data in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(),
                                                  batch.column("places").to_pylist(), _unpacked(batch.column("packed"))):
                rows += [(p["gram"], doc, version, p["low"], p["high"], p["anchor"], data[p["low"]:p["high"] + length]) for p in places]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             names=[c.split()[0] for c in CONTEXTS.split(", ")])

    return run


MARKS = f"{DOC}, low long, high long"


def repeats_of_groups(records: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Window starts that are repeats, as (doc, version, first, last). ``records``: whole groups of one gram each,
    (gram, doc, version, low, high, anchor, bytes), in order of gram.

    The suffixes at the anchors of a group are sorted, and so are the prefixes that end there, read backwards. A
    window that starts d bytes before its anchor equals another of its group if d bytes to the left and
    ``length`` - d to the right agree, which the common prefixes of neighbours in the two orders tell.
    """
    records = sorted(set(records), key=lambda r: (r[0], r[1], r[2], r[5]))
    n = len(records)
    gram = np.array([r[0] for r in records])
    low, high, anchor = (np.array([r[k] for r in records], dtype=np.int64) for k in (3, 4, 5))
    orders = []
    for side in (0, 1):
        order, shared, begin = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
        for end in [*(np.flatnonzero(np.diff(gram)) + 1), n]:
            strings = [r[6][r[5] - r[3]:][:length] if side else r[6][:r[5] - r[3]][::-1] for r in records[begin:end]]
            one, lcp = deep_shallow(strings)
            order[begin:end], shared[begin:end] = np.array(one) + begin, lcp
            begin = end
        orders.append((order, shared))
    found = []
    for d in range(int((anchor - high).min()), int((anchor - low).max()) + 1):
        rows = np.flatnonzero((anchor - high <= d) & (d <= anchor - low))
        if len(rows) < 2:
            continue
        key = np.zeros(n, dtype=np.int64)
        for (order, shared), depth in zip(orders, (d, length - d)):
            cls = np.empty(n, dtype=np.int64)
            cls[order] = np.cumsum(shared < depth)
            key = key * (n + 1) + cls
        _, first = np.unique(key[rows], return_index=True)
        again = np.ones(len(rows), dtype=bool)
        again[first] = False
        found.append(np.column_stack([rows[again], anchor[rows[again]] - d]))
    if not found:
        return
    hits = np.concatenate(found)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 1)])) if len(hits) else []
    for a, b in zip(new, [*new[1:], len(hits)]):
        yield records[hits[a, 0]][1], records[hits[a, 0]][2], int(hits[a, 1]), int(hits[b - 1, 1])


def _sorted_groups(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(rows):
            marks = list(repeats_of_groups(rows, length))
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in marks], pa.int64()) for k in range(4)],
                                              names=["doc", "version", "low", "high"])

        held: list[tuple] = []
        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns)))
            if len(held) >= BATCH_RECORDS:
                cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
                if cut:
                    yield marked(held[:cut])
                    held = held[cut:]
        if held:
            yield marked(held)

    return run


def _window_digests(length: int):
    """For grams with very many contexts: each window by itself, to be grouped by its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hashlib.blake2b(data[p - low:p - low + length], digest_size=16).digest(), doc, version, p)
                    for _, doc, version, low, high, _, data in zip(*(c.to_pylist() for c in batch.columns))
                    for p in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.binary(), *[pa.int64()] * 3])],
                names=["digest", "doc", "version", "place"])

    return run


def repeated_windows(docs: DataFrame, length: int = 100, hot_group: int = 100_000) -> DataFrame:
    """``doc, version, low, high``: runs of starts of ``length``-byte windows that also start earlier.

    ``doc`` is the doc_id (the largest long for null), ``version`` a hash of the text. Four steps: (1) each task
    finds the anchors of its texts and combines equal contexts; (2) anchors meet by gram, copies of a context are
    repeats of its earliest, and only grams with several different contexts go on; (3) those contexts are cut
    from the texts; (4) each gram's suffixes are sorted. A gram with more than ``hot_group`` contexts is too much for one task; its
    windows are grouped one by one by a 128-bit digest instead, with minima combined before the shuffle.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(whole(docs["text"])).alias("version"), whole(docs["text"]).alias("text"))
    found = rows.where(F.octet_length("text") >= length).mapInArrow(_anchor_batches(length), RECORDS).repartition("gram")
    of_gram = Window.partitionBy("gram")
    ranked = (found.withColumn("nth", F.rank().over(Window.partitionBy("gram", "context").orderBy("doc", "version", "low")))
              .withColumn("several", F.min("context").over(of_gram) != F.max("context").over(of_gram)))
    judged = written(ranked.select("gram", "doc", "version", "low", "high", "anchor", (F.col("mark") | (F.col("nth") > 1)).alias("again"),
                                   "several").where("again or several"), "anchors")
    marks = judged.where("again").select("doc", "version", "low", "high")
    places = (judged.where("not again").groupBy("doc", "version")
              .agg(F.collect_set(F.struct("gram", "low", "high", "anchor")).alias("places")))
    packed = rows.where(F.octet_length("text") >= length).mapInArrow(_packed, f"{DOC}, packed binary")
    contexts = written(packed.join(places, ["doc", "version"]).mapInArrow(_context_batches(length), CONTEXTS), "contexts")
    hot = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_group).select("gram"), "hot")
    usual = contexts.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    marks = marks.unionByName(usual.mapInArrow(_sorted_groups(length), MARKS))
    if not hot.isEmpty():
        single = contexts.join(hot, "gram", "left_semi").mapInArrow(
            _window_digests(length), f"digest binary, {DOC}, place long")
        least = single.groupBy("digest").agg(F.min(F.struct("doc", "version", "place")).alias("least"))
        later = single.join(least, "digest").where(F.struct("doc", "version", "place") != F.col("least"))
        marks = marks.unionByName(later.select("doc", "version", F.col("place").alias("low"), F.col("place").alias("high")))
    return marks


def removed_spans(n_bytes: int, runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The union of the windows that start in the runs, as maximal (start, end)."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], high + length))
        else:
            spans.append((low, high + length))
    return spans


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans`` (removed byte ranges) and ``kept_bytes``.

    Every byte covered by a ``length``-byte string that also starts earlier, in a document before or at an earlier
    place, is removed; strings never cross documents. Documents are in order of doc_id, null ids last.

    Null text: an empty one, nothing to remove. Rows alike in doc_id and text are one document and get the same result;
    different texts under one doc_id are in order of a hash of the text. An empty table gives no rows; other
    columns are ignored.
    """
    marks = written(repeated_windows(docs, length), "repeats")
    runs = marks.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(whole(docs["text"])).alias("version"), whole(docs["text"]).alias("text"))
    packed = rows.mapInArrow(_packed, f"doc_id long, {DOC}, packed binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, spans, kept = [], [], []
            for runs_of, data in zip(batch.column("runs").to_pylist(), _unpacked(batch.column("packed"))):
                gone = removed_spans(len(data), [(r["low"], r["high"]) for r in runs_of or []], length)
                size.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept_bytes"])

    return packed.join(runs, ["doc", "version"], "left").select("doc_id", "runs", "packed").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_bytes binary")
