"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import whole
from keepsake.llm.hashing import mixed, text_chunks, word_hashes

# Which of the words of a window count; the others may be anything.
MASKS = ("111011", "1101100101", "1110010011", "10110100101", "110010010101")
PIECE = 3  # words of an item that make a seed of their own, if enough of them
TABLE_BITS = 22
HITS = "doc_id long, item_id long, doc_start long, item_start long, n_aligned long, n_equal long"
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64))


@dataclass
class Index:
    """Seeds of a block of benchmark items: for each mask a sorted hash, and the item and position it stands for."""
    items: list
    words: list[np.ndarray]
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    masks: list[np.ndarray]
    table: np.ndarray
    min_words: int
    penalty: float


def masked(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The hash of the words under the mask, for each window."""
    n = len(words) - int(mask[-1])
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in mask:
        out += words[k:k + n] * _FACTORS[k]
    return mixed(out + np.uint64(mask.sum()))


def short_seeds(n: int, min_words: int) -> list[tuple[tuple[int, ...], int]]:
    """Masks and positions such that, in an item of ``n`` words of which four fifths are enough, whichever words differ
    leave one of them whole. Cut into one piece more than words may differ, a piece stays equal; where pieces would be
    shorter than ``PIECE``, each word is left out in turn, for which one differing word must be all."""
    spare = int(n - np.ceil(min(min_words, 0.8 * n)))
    if not spare:
        return [(tuple(range(n)), 0)]
    if n // (spare + 1) < PIECE and spare == 1:
        kept = [tuple(k for k in range(n) if k != out) for out in range(n)]
        return [(tuple(k - places[0] for k in places), places[0]) for places in kept]
    cuts = [n * k // (spare + 1) for k in range(spare + 2)]
    return [(tuple(range(end - start)), start) for start, end in zip(cuts, cuts[1:])]


def build_index(rows: list[tuple], min_words: int, penalty: float) -> Index:
    """``rows``: (item_id, text). All windows of an item are seeded by the spaced masks; items short enough that four fifths of
    them count have ``short_seeds`` too, which miss none of the overlaps that count. In longer items only the masks
    find the place, so an overlap that differs from the item in a word of every masked window isn't found."""
    items = [i for i, _ in rows]
    words = [word_hashes([t or ""])[0] for _, t in rows]
    masks = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
    table, seeds = np.zeros(1 << TABLE_BITS, dtype=bool), []
    found = [[(h := masked(w, mask), np.full(len(h), number), np.arange(len(h))) for number, w in enumerate(words)] for mask in masks]
    short: dict[tuple[int, ...], list] = {}
    for number, w in enumerate(words):
        if 0 < len(w) and 0.8 * len(w) < min_words:
            for mask, start in short_seeds(len(w), min_words):
                h = masked(w[start:start + mask[-1] + 1], np.array(mask))
                short.setdefault(mask, []).append((h, np.full(1, number), np.full(1, start)))
    masks += [np.array(mask) for mask in short]
    for parts in [*found, *short.values()]:
        h, item, position = (np.concatenate(x) for x in zip(*parts)) if parts else (
            np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=int), np.zeros(0, dtype=int))
        order = np.argsort(h, kind="stable")
        seeds.append((h[order], item[order], position[order]))
        table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Index(items, words, seeds, masks, table, min_words, penalty)


def _diagonals(words: np.ndarray, bounds: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (text, item, text position - item position) at which some seed of an item meets a text."""
    found = []
    for mask, (hashes, items, positions) in zip(index.masks, index.seeds):
        if not len(hashes):
            continue
        window = masked(words, mask)
        at = np.flatnonzero(index.table[(window >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        low = np.searchsorted(hashes, window[at], side="left")
        count = np.searchsorted(hashes, window[at], side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + mask[-1] < bounds[text + 1]
        at, low, count, text = at[inside], low[inside], count[inside], text[inside]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) \
            if len(count) else np.zeros(0, dtype=int)
        found.append(np.column_stack([np.repeat(text, count), items[entry], np.repeat(at, count) - positions[entry]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=int)


def _best_run(equal: np.ndarray, penalty: float) -> tuple[int, int]:
    """Start and end of the run with most equal words, less ``penalty`` for each other word; of several the one with
    most equal words."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -penalty))])
    lowest = np.minimum.accumulate(total)
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], total[1:] < lowest[:-1]]), np.arange(len(total)), 0))
    ends = np.flatnonzero(total - lowest == (total - lowest).max())
    count = np.concatenate([[0], np.cumsum(equal)])
    end = int(ends[np.argmax(count[ends] - count[starts[ends]])])
    return int(starts[end]), end


def overlaps(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, text start, item start, words aligned, words equal) of the best verified overlap of each text
    and item. Around a seed hit both word lists are laid over each other; the overlap counts if its best run holds
    ``min_words`` equal words, or four fifths of a shorter item."""
    for a, b in text_chunks(texts):
        words, bounds = word_hashes(texts[a:b])
        best: dict[tuple[int, int], tuple] = {}
        for text, item, shift in _diagonals(words, bounds, index).tolist():
            other = index.words[item]
            low = max(0, int(bounds[text]) - shift)
            high = min(len(other), int(bounds[text + 1]) - shift)
            equal = words[low + shift:high + shift] == other[low:high]
            start, end = _best_run(equal, index.penalty)
            n = int(equal[start:end].sum())
            if n >= min(index.min_words, 0.8 * len(other)) and n > best.get((text, item), (0,))[0]:
                best[text, item] = (n, low + start + shift - int(bounds[text]), low + start, end - start)
        for (text, item), (n, at, from_, aligned) in sorted(best.items()):
            yield a + text, item, at, from_, aligned, n


def benchmark_blocks(benchmark: DataFrame, min_words: int = 10, penalty: float = 1.0,
                     block_chars: int = 16_000_000) -> list[Index]:
    """The benchmark as indexes of about ``block_chars`` characters each: only one block at a time is in a task's
    memory or passes the driver, however large the benchmark is."""
    total = benchmark.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        rows = (benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
                .select("item_id", "text").distinct().collect())
        yield build_index([tuple(r) for r in rows], min_words, penalty)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id, item_id``, where the overlap starts in the
    words of each, how many words it aligns and how many of them are equal.

    Each mask hashes some words of every window of both sides and ignores the others; equal hashes are joined (the
    benchmark's side is a broadcast block of bounded size), and each hit is verified by laying the word lists over
    each other, which tolerates substituted words. Words are lower-cased, punctuation is ignored. A null or empty
    text on either side overlaps nothing. Repeated rows each give their rows; rows alike in the benchmark count once.
    """
    spark, found = docs.sparkSession, None
    kept = docs.select("doc_id", whole(docs["text"]).alias("text"))
    for index in benchmark_blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.items[i], *rest) for t, i, *rest in overlaps(batch.column("text").to_pylist(), index)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], type=pa.int64()) for k in range(6)],
                    names=["doc_id", "item_id", "doc_start", "item_start", "n_aligned", "n_equal"])

        block = kept.mapInArrow(run, HITS)
        found = block if found is None else found.unionByName(block)
    return found


def without_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap no benchmark item, all their columns unchanged."""
    for index in benchmark_blocks(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                clean = np.ones(len(texts), dtype=bool)
                clean[[t for t, *_ in overlaps(texts, shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
