"""Repeated word passages across a corpus, by suffix trees of groups that share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import whole, written
from keepsake.llm.hashing import SPACED_BYTES, cut_words, mixed, range_sums

GRAM = 4  # words of an anchor
CHUNK_BYTES, COMBINED_ANCHORS, BATCH_SUFFIXES = 500_000, 200_000, 30_000
ROWS_AT_ONCE, DOCS_AT_ONCE = 5_000, 500
_FACTORS = mixed(np.arange(501, 501 + GRAM, dtype=np.uint64))
DOC = "doc long, version long"
ANCHORS = f"gram long, context long, {DOC}, low int, high int, anchor int, again boolean"
SUFFIXES = f"prefix long, {DOC}, low int, high int, anchor int, words binary"
MARKS = f"{DOC}, low int, high int"


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The anchors of the word sequences ``words[bounds[i]:bounds[i + 1]]`` and the windows that each one serves.

    A window's anchor is the gram of 4 words with the least hash in it, of equals the last: equal windows have equal
    anchors at equal distances. Arrays: ``part``; ``low`` and ``high``, the first and last start of the windows; ``anchor``, its
    place in the part; ``gram``, a hash of its words; ``context``, one of all words of the windows.
    """
    sizes = np.diff(bounds)
    windows = np.maximum(sizes - window + 1, 0)
    part = np.repeat(np.arange(len(sizes)), windows)
    if not len(part):
        none = np.zeros(0, dtype=np.int64)
        return {k: none for k in ("part", "low", "high", "anchor", "gram", "context")}
    grams = np.zeros(len(words) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams += words[k:k + len(grams)] * _FACTORS[k]
    grams = mixed(grams)
    least, at, span, reach = grams, np.arange(len(grams)), window - GRAM + 1, 1
    while reach < span:  # the least gram of ``reach`` neighbours, then of twice as many
        step = min(reach, span - reach)
        take = least[step:] <= least[:-step]
        least, at = np.where(take, least[step:], least[:-step]), np.where(take, at[step:], at[:-step])
        reach += step
    start = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows - bounds[:-1], windows)
    own = at[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(part) != 0)]))
    last = np.concatenate([new[1:] - 1, [len(own) - 1]])
    low, high, anchor, part = start[new], start[last], own[new], part[new]
    shape = ((anchor - low) * 1009 + (high - low)).astype(np.uint64)
    context = mixed(range_sums(words.copy(), low, high + window) + mixed(shape))
    base = bounds[:-1][part]
    return {"part": part, "low": low - base, "high": high - base, "anchor": anchor - base, "gram": grams[anchor].view(np.int64),
            "context": context.view(np.int64)}


def _word_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For neighbouring texts (the last column, each with a space at its end): the first one's number, hashes of all words, and
    where each text's words start."""
    texts = batch.column(batch.num_columns - 1)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data, begin = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and ends[-1] else np.zeros(0, np.uint8), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHUNK_BYTES, side="right")) - 1)
        starts, _, words = cut_words(data[ends[begin]:ends[end]], SPACED_BYTES)
        yield begin, words, np.searchsorted(starts, ends[begin:end + 1] - ends[begin])
        begin = end


def _gram_counts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, bounds in _word_chunks(batch):
                gram, n = np.unique(anchors(words, bounds, window)["gram"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def _combined(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of anchors with equal contexts the earliest goes on; the windows of the others are repeats already."""
    order = np.lexsort((found["low"], found["version"], found["doc"], found["context"], found["gram"]))
    found = {k: v[order] for k, v in found.items()}

    def alike(*names: str) -> np.ndarray:
        return np.concatenate([[False], np.logical_and.reduce([found[k][1:] == found[k][:-1] for k in names])])

    again = alike("gram", "context")
    kept = ~alike("gram", "context", "doc", "version", "low")  # the same place of a repeated row
    spread = mixed((found["doc"] ^ (found["low"] * 7919)).view(np.uint64)).view(np.int64)
    found["gram"], found["context"] = np.where(again, spread, found["gram"]), np.where(again, spread, found["context"])
    columns = [*(found[k][kept] for k in ("gram", "context", "doc", "version")),
               *(found[k][kept].astype(np.int32) for k in ("low", "high", "anchor")), again[kept]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ANCHORS.split(", ")])


def _anchor_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def joined():
            return _combined({k: np.concatenate([f[k] for f in held]) for k in held[0]})

        for batch in batches:
            doc, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, words, bounds in _word_chunks(batch):
                found = anchors(words, bounds, window)
                part = found.pop("part") + begin
                held.append(found | {"doc": doc[part], "version": version[part]})
                count += len(part)
                if count >= COMBINED_ANCHORS:
                    yield joined()
                    held, count = [], 0
        if count:
            yield joined()

    return run


def _suffix_batches(window: int):
    """The words of each wanted place, from the first window's first to the last one's last, joined by one space."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                          names=[c.split()[0] for c in SUFFIXES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for doc, version, places, text in zip(*(batch.column(n) for n in ("doc", "version", "places", "text"))):
                words, doc, version = text.as_py().split(), doc.as_py(), version.as_py()
                rows += [(p["gram"], doc, version, p["low"], p["high"], p["anchor"], b" ".join(words[p["low"]:p["high"] + window]))
                         for p in places.as_py()]
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)

    return run


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and where each row's begin."""
    rows = words.to_pylist()
    starts, _, hashes = cut_words(np.frombuffer(b" ".join([*rows, b""]), dtype=np.uint8), SPACED_BYTES)
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])]))


def subtree(prefix: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """The tree of the suffixes ``words[begin], words[begin + step], ...`` (``size`` words each) that start with equal prefixes,
    one level after the other.

    Each level says for every suffix which node of that depth it passes: a number that suffixes below one node share, or
    -1 if the suffix passes none with others below it. The first level's nodes are the prefixes. A node is divided by
    its suffixes' next words; a suffix that parts from all others is a leaf and is not followed further.
    """
    _, node = np.unique(prefix, return_inverse=True)
    depth = 0
    while True:
        shared = np.bincount(node[node >= 0], minlength=1)
        node = np.where((node >= 0) & (shared[np.maximum(node, 0)] > 1), node, -1)
        yield node
        alive = np.flatnonzero((node >= 0) & (size > depth))
        following = words[begin[alive] + step * depth]
        order = np.lexsort((following, node[alive]))
        alive, following = alive[order], following[order]
        new = np.concatenate([[True], (np.diff(node[alive]) != 0) | (following[1:] != following[:-1])]) if len(alive) else np.zeros(0, bool)
        node = np.full(len(prefix), -1)
        node[alive] = np.cumsum(new) - 1
        depth += 1


def repeats_of_groups(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Window starts that are repeats, as runs. ``rows`` has the columns of ``SUFFIXES``, whole groups of equal prefixes.

    A window that starts d words before its anchor equals another of its group if the d words to the left and the
    ``window`` - d from the anchor on agree. Those on the right are followed down the tree of the suffixes that start
    at the anchors, those on the left down the tree of what comes before them, read backwards. Pairs of nodes at the
    depths d and ``window`` - d hold the repeats: all suffixes below but the earliest.
    """
    rows = rows.sort_by([(k, "ascending") for k in ("prefix", "doc", "version", "anchor", "low")])
    prefix, doc, version, low, high, anchor = (rows[k].to_numpy().astype(np.int64) for k in ("prefix", "doc", "version", "low", "high", "anchor"))
    words, bounds = _hashed(rows["words"].combine_chunks())
    middle = bounds[:-1] + anchor - low
    right = subtree(prefix, words, middle, bounds[1:] - middle, 1)
    left = subtree(prefix, words, middle - 1, anchor - low, -1)
    right, left = ([level for level, _ in zip(tree, range(window + 1))] for tree in (right, left))
    found = []
    for d in range(int((anchor - high).min()), int((anchor - low).max()) + 1):
        has = np.flatnonzero((anchor - high <= d) & (d <= anchor - low) & (left[d] >= 0) & (right[window - d] >= 0))
        same = left[d][has] * (len(prefix) + 1) + right[window - d][has]
        _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
        lead = has[first[inverse]]
        later = (has != lead) & ((doc[has] != doc[lead]) | (version[has] != version[lead]) | (anchor[has] != anchor[lead]))
        found.append(np.column_stack([has[later], anchor[has[later]] - d]))
    hits = np.concatenate(found)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 1)])) if len(hits) else np.zeros(0, int)
    last = np.concatenate([new[1:], [len(hits)]]) - 1 if len(new) else new
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[hits[new, 0]]), pa.array(version[hits[new, 0]]), pa.array(hits[new, 1].astype(np.int32)), pa.array(hits[last, 1].astype(np.int32))],
        names=[c.split()[0] for c in MARKS.split(", ")])


def _trees(window: int):
    """For rows in order of prefix: the repeats of whole groups, some groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BATCH_SUFFIXES:
                rows = pa.Table.from_batches(held)
                prefix = rows["prefix"].to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))
                if cut:
                    yield repeats_of_groups(rows.slice(0, cut), window)
                    held = rows.slice(cut).combine_chunks().to_batches()
                    count = rows.num_rows - cut
        if count:
            yield repeats_of_groups(pa.Table.from_batches(held), window)

    return run


def _longer_prefixes(ranges: list[tuple[int, int]], window: int):
    """Suffixes of groups too large, once for each range (a, b) of distances d between window and anchor: with the windows at those
    distances alone, and as prefix all that these have in common, a words before the anchor and ``window`` - b from it on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(k, ROWS_AT_ONCE) for whole_batch in batches for k in range(0, whole_batch.num_rows, ROWS_AT_ONCE)):
            low, high, anchor = (batch.column(k).to_numpy().astype(np.int64) for k in ("low", "high", "anchor"))
            hashes, bounds = _hashed(batch.column("words"))
            texts = [t.split(b" ") for t in batch.column("words").to_pylist()]
            for number, (a, b) in enumerate(ranges):
                first, last = np.maximum(low, anchor - b), np.minimum(high, anchor - a)
                has = np.flatnonzero(first <= last)
                if not len(has):
                    continue
                middle = bounds[:-1][has] + (anchor - low)[has]
                prefix = mixed(range_sums(hashes.copy(), middle - a, middle + window - b) + np.uint64(number + 1))
                words = [b" ".join(texts[i][f - o:t + window - o]) for i, f, t, o in
                         zip(has.tolist(), first[has].tolist(), last[has].tolist(), low[has].tolist())]
                some = batch.take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.view(np.int64)), some.column("doc"), some.column("version"), pa.array(first[has].astype(np.int32)),
                     pa.array(last[has].astype(np.int32)), some.column("anchor"), pa.array(words, pa.binary())],
                    names=[c.split()[0] for c in SUFFIXES.split(", ")])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = [hashlib.blake2b(w, digest_size=16).digest() for w in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), batch.column("doc"), batch.column("version"), batch.column("low")],
                                         names=["digest", "doc", "version", "low"])


def distance_ranges(window: int) -> list[list[tuple[int, int]]]:
    """The ranges of distances of each step of ever longer prefixes: quarters of 0 to ``window`` - 4, then each by itself."""
    all_of_them = range(window - GRAM + 1)
    quarters = [list(q) for q in np.array_split(np.array(all_of_them), 4) if len(q)]
    return [[(int(q[0]), int(q[-1])) for q in quarters], [(d, d) for d in all_of_them]]


def repeated_passages(docs: DataFrame, window: int = 20, group_size: int = 10_000) -> DataFrame:
    """``doc, version, low, high``: runs of starts of ``window``-word windows that also start earlier.

    ``doc`` is the doc_id (the largest long for null), ``version`` a hash of the text. Suffixes start at anchors, content-defined
    places of which every window has one; a group is the suffixes that start with one prefix, at first the anchor's 4 words.

    (1) Suffixes are counted by prefix. (2) They meet by prefix, those of prefixes over ``group_size`` spread over several tasks.
    Of suffixes whose windows are all equal (by a 64-bit hash of the words within a 64-bit hash of the prefix) the later ones are
    repeats of the earliest; of the rest, prefixes with different suffixes go on. (3) Their words are cut from the texts. (4) A
    group of at most ``group_size`` suffixes gets its subtrees. A larger one is divided by longer prefixes: of 16 words or more, four
    kinds for windows that lie differently around the anchor, then of the whole window, where a group is equal
    windows and only its earliest is looked for, minima combined before the shuffle.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(whole(docs["text"])).alias("version"),
                       F.concat(whole(docs["text"]), F.lit(" ")).cast("binary").alias("text"))
    counts = rows.select("text").mapInArrow(_gram_counts(window), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = written(counts.where(F.col("n") > group_size).select("gram", F.ceil(F.col("n") / group_size).alias("parts")), "frequent")
    found = rows.mapInArrow(_anchor_batches(window), ANCHORS)
    salt = F.lit(None).cast("long")
    if not frequent.isEmpty():
        found = found.join(frequent, "gram", "left")
        salt = F.pmod("context", F.col("parts"))
    found = found.withColumn("salt", salt).drop("parts").repartition("gram", "salt")
    of_gram = Window.partitionBy("gram", "salt")
    of_context = Window.partitionBy("gram", "salt", "context").orderBy("doc", "version", "low")
    judged = found.withColumn("nth", F.rank().over(of_context)).withColumn(
        "several", F.col("salt").isNotNull() | (F.min("context").over(of_gram) != F.max("context").over(of_gram)))
    judged = written(judged.select("gram", "doc", "version", "low", "high", "anchor", (F.col("again") | (F.col("nth") > 1)).alias("again"), "several")
                     .where("again or several"), "anchors")
    marks = judged.where("again").select("doc", "version", "low", "high")
    firsts = judged.where("not again").drop("again", "several")
    large = written(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_size).select("gram"), "large")

    def suffixes(places: DataFrame) -> DataFrame:
        of_doc = places.groupBy("doc", "version").agg(F.collect_set(F.struct("gram", "low", "high", "anchor")).alias("places"))
        return rows.join(of_doc, ["doc", "version"]).mapInArrow(_suffix_batches(window), SUFFIXES)

    def repeats(groups: DataFrame) -> DataFrame:
        return groups.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(window), MARKS)

    if large.isEmpty():
        return marks.unionByName(repeats(suffixes(firsts)))
    marks = marks.unionByName(repeats(suffixes(firsts.join(large, "gram", "left_anti"))))
    rest = written(suffixes(firsts.join(large, "gram", "left_semi")), "suffixes")
    quarters, single = distance_ranges(window)
    divided = written(rest.mapInArrow(_longer_prefixes(quarters, window), SUFFIXES), "suffixes")
    large = written(divided.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_size).select("prefix"), "large")
    marks = marks.unionByName(repeats(divided.join(large, "prefix", "left_anti")))
    windows = divided.join(large, "prefix", "left_semi").mapInArrow(_longer_prefixes(single, window), SUFFIXES)
    equal = windows.mapInArrow(_digests, f"digest binary, {DOC}, low int")
    least = equal.groupBy("digest").agg(F.min(F.struct("doc", "version", "low")).alias("least"))
    later = equal.join(least, "digest").where(F.struct("doc", "version", "low") != F.col("least"))
    return marks.unionByName(later.select("doc", "version", "low", F.col("low").alias("high")))


def removed_spans(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The union of the windows that start in the runs, as maximal (start, end) in words."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], high + window))
        else:
            spans.append((low, high + window))
    return spans


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (whole_batch.slice(k, DOCS_AT_ONCE) for whole_batch in batches for k in range(0, whole_batch.num_rows, DOCS_AT_ONCE)):
            size, spans, kept = [], [], []
            for runs, text in zip(batch.column("runs").to_pylist(), batch.column("text")):
                words = text.as_py().split()
                gone = removed_spans([(r["low"], r["high"]) for r in runs or []], window)
                size.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in gone])
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept_text"])

    return run


def remove_passages(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans`` (removed word ranges) and ``kept_text``, the other words joined by one space.

    Words are cut at ASCII white space. Every word covered by a window of ``window`` words that also starts earlier, in a document
    before or at an earlier place, is removed; windows never cross documents and are judged on the input. Documents are in order of
    doc_id, null ids last.

    Null text: no words. Rows alike in doc_id and text are one document and get the same result; different texts under one
    doc_id are in order of a hash of the text. An empty table gives no rows; other columns are ignored.
    """
    marks = written(repeated_passages(docs, window, **options), "repeats")
    runs = marks.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(whole(docs["text"])).alias("version"), whole(docs["text"]).cast("binary").alias("text"))
    return rows.join(runs, ["doc", "version"], "left").select("doc_id", "runs", "text").mapInArrow(
        _cut(window), "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept_text string")
