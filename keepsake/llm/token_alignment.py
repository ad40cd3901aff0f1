"""Tokens of two vocabularies over the same bytes, aligned by divide and conquer at shared cuts."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import written
from keepsake.llm.hashing import text_chunks

# A unit goes from a space that follows a non-space to the next such space. No token of either kind crosses it.
UNIT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
KNOWN_UNITS = 400_000
FEW_LINKS = 64
BLOCK_CHARS = 2_000_000
LEARN_AT_ONCE = 2_000


def shared_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """The finest groups of tokens that cover the same bytes, as (first, past the last) of A and then of B, in order.

    ``ends_a`` and ``ends_b`` are ascending ends of tokens over the same bytes, the last ones equal. An interval is divided at
    the shared end nearest its middle: from there outward each end of A is looked up among those of B by bisection.
    Both halves are divided further; an interval without a shared end inside is a group.
    """
    groups = []
    stack = [(0, len(ends_a), 0, len(ends_b))] if ends_a else []
    while stack:
        a, a_end, b, b_end = stack.pop()
        last_a, last_b = a_end - 1, b_end - 1
        if a == last_a or b == last_b:
            groups.append((a, a_end, b, b_end))
            continue
        middle = ((ends_a[a - 1] if a else 0) + ends_a[last_a]) // 2
        right = bisect_left(ends_a, middle, a, last_a)
        left = right - 1
        while True:
            if right < last_a and (left < a or ends_a[right] - middle <= middle - ends_a[left]):
                at, right = right, right + 1
            elif left >= a:
                at, left = left, left - 1
            else:
                groups.append((a, a_end, b, b_end))
                break
            met = bisect_left(ends_b, ends_a[at], b, last_b)
            if met < last_b and ends_b[met] == ends_a[at]:
                stack.append((at + 1, a_end, met + 1, b_end))
                stack.append((a, at + 1, b, met + 1))
                break
    return groups


class Aligner:
    """Encodes texts with both vocabularies and aligns the tokens, one distinct unit of text at a time.

    What is known of a unit is kept, and forgotten at ``limit`` units, so memory is bounded. A text whose units don't
    give its bytes back is encoded whole; one that then still doesn't has no tokens. If a piece of B could cross units,
    every text is one unit.
    """

    def __init__(self, path_a: str, path_b: str, limit: int = KNOWN_UNITS):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes whose letter in the vocabulary is their own code point
        letters = dict(zip(map(chr, direct), direct))
        letters |= dict(zip(map(chr, range(256, 324)), sorted(set(range(256)) - set(direct))))
        assert set(letters) == set(ByteLevel.alphabet())
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.text_a, self.text_b = [f"{i}|" for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        self.space = pieces.index("▁")
        self.units = UNIT.findall if not any("▁" in p.lstrip("▁") for p in pieces) else lambda text: [text]
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # unit -> its entry below; -1: not its own bytes
        self.groups: list[str] = []
        self.counts = array("q")  # of each entry: tokens of A, of B, groups, links
        self.pairs, self.times = array("q"), array("q")  # linked ids a << 32 | b, and how often in the entry
        self.starts = array("q", [0])  # of each entry's pairs

    def ids(self, units: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Both encodings of texts that start with a space, which B adds itself."""
        for i in range(0, len(units), LEARN_AT_ONCE):
            some = units[i:i + LEARN_AT_ONCE]
            in_a = self.a.encode_batch_fast(some, add_special_tokens=False)
            in_b = self.b.encode([u[1:] for u in some], num_threads=1)
            for unit, a, b in zip(some, in_a, in_b):
                yield unit, a.ids, b if len(unit) > 1 else [self.space]

    def learn(self, units: list[str], keep: bool = True) -> int:
        """Entries for new units; the last one's number, -1 if its tokens don't give its bytes."""
        entry = -1
        bytes_a, bytes_b, size_a, size_b = (x.__getitem__ for x in (self.bytes_a, self.bytes_b, self.size_a, self.size_b))
        for unit, in_a, in_b in self.ids(units):
            entry, data = -1, unit.encode("utf-8", "surrogatepass")
            if b"".join(map(bytes_a, in_a)) == data and b"".join(map(bytes_b, in_b)) == data:
                entry = len(self.groups)
                self._add(in_a, in_b, shared_groups(list(accumulate(map(size_a, in_a))), list(accumulate(map(size_b, in_b)))))
            if keep:
                self.known[unit] = entry
        return entry

    def _add(self, in_a: list[int], in_b: list[int], groups: list[tuple[int, int, int, int]]) -> None:
        links: dict[int, int] = {}
        n_links, said, text_a, text_b = 0, [], self.text_a, self.text_b
        for a, a_end, b, b_end in groups:
            if a_end - a == 1 and b_end - b == 1:
                x, y = in_a[a], in_b[b]
                said.append(text_a[x] + text_b[y])
                pair = x << 32 | y
                links[pair] = links.get(pair, 0) + 1
                n_links += 1
                continue
            group_a, group_b = in_a[a:a_end], in_b[b:b_end]
            said.append(f"{','.join(map(str, group_a))}|{','.join(map(str, group_b))}")
            n_links += len(group_a) * len(group_b)
            if len(group_a) * len(group_b) <= FEW_LINKS:
                for x in group_a:
                    for y in group_b:
                        pair = x << 32 | y
                        links[pair] = links.get(pair, 0) + 1
                continue
            times_b = Counter(group_b)
            for x, n in Counter(group_a).items():
                for y, m in times_b.items():
                    pair = x << 32 | y
                    links[pair] = links.get(pair, 0) + n * m
        self.groups.append(";".join(said))
        self.counts.extend((len(in_a), len(in_b), len(groups), n_links))
        self.pairs.extend(links)
        self.times.extend(links.values())
        self.starts.append(len(self.pairs))

    def entries(self, texts: list[str | None]) -> list[list[int]]:
        """The entries that each text consists of; none where it has no tokens."""
        if len(self.groups) > self.limit:
            self.clear()
        cut = [self.units(" " + t) if t else [] for t in texts]
        known = self.known
        self.learn(list(dict.fromkeys(u for units in cut for u in units if u not in known)))
        out = []
        for text, units in zip(texts, cut):
            found = [known[u] for u in units]
            if -1 in found:
                whole = self.learn([" " + text], keep=False)
                found = [whole] if whole >= 0 else []
            out.append(found)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}  # of this Python worker: what it knows serves its later tasks


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = stops - starts
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, dtype=np.int64)
    return np.repeat(stops - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PER_DOC = ("doc_id", *COUNTS, "groups")
KINDS = {"doc_start": "<i8", "unit": "<u4", "unit_times": "<u4", "unit_start": "<u4", "unit_pair": "<u4", "pair_times": "<u4",
         "pair": "<i8", "pair_docs": "<u4"}
BLOCK = ", ".join(["block long", *(f"{n} array<{'string' if n == 'groups' else 'long'}>" for n in PER_DOC), *(f"{n} binary" for n in KINDS)])


def _block(aligner: Aligner, doc_ids: pa.Array, texts: list[str | None], digest: bool) -> dict:
    """What is known of neighbouring documents: each one's counts and groups, its units, their pairs, and in how
    many of the documents each pair is linked."""
    entries = aligner.entries(texts)
    said = []
    for found in entries:
        text = ";".join([aligner.groups[e] for e in found])
        said.append(hashlib.sha256(text.encode()).hexdigest() if digest and found else text)
    sizes = np.array([len(e) for e in entries], dtype=np.int64)
    flat = np.fromiter((e for found in entries for e in found), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(entries)), sizes)
    counts = np.frombuffer(aligner.counts, dtype=np.int64).reshape(-1, 4)[flat]
    summed = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(counts, axis=0)])
    totals = np.diff(summed[np.concatenate([[0], np.cumsum(sizes)])], axis=0)
    used, local = np.unique(flat, return_inverse=True)
    once, times = np.unique(doc * max(1, len(used)) + local, return_counts=True)
    doc, unit = once // max(1, len(used)), once % max(1, len(used))
    starts = np.frombuffer(aligner.starts, dtype=np.int64)
    rows = _spans(starts[used], starts[used + 1])
    pair, unit_pair = np.unique(np.frombuffer(aligner.pairs, dtype=np.int64)[rows], return_inverse=True)
    unit_start = np.concatenate([[0], np.cumsum(starts[used + 1] - starts[used])])
    linked = unit_pair[_spans(unit_start[unit], unit_start[unit + 1])]
    held = np.unique(np.repeat(doc, unit_start[unit + 1] - unit_start[unit]) * max(1, len(pair)) + linked) % max(1, len(pair))
    arrays = {"doc_start": np.searchsorted(doc, np.arange(len(entries) + 1)), "unit": unit, "unit_times": times, "unit_start": unit_start,
              "unit_pair": unit_pair, "pair_times": np.frombuffer(aligner.times, dtype=np.int64)[rows], "pair": pair,
              "pair_docs": np.bincount(held, minlength=len(pair)) if len(pair) else np.zeros(0, dtype=np.int64)}
    return {"doc_id": doc_ids.to_pylist(), **{n: totals[:, k].tolist() for k, n in enumerate(COUNTS)}, "groups": said,
            **{n: _packed(arrays[n], kind) for n, kind in KINDS.items()}}


def _blocks(path_a: str, path_b: str, digest: bool, chars: int):
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((n, pa.list_(pa.int64())) for n in COUNTS),
                        ("groups", pa.list_(pa.string())), *((n, pa.binary()) for n in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        held_ids, held = [], []

        def block():
            found = _block(aligner, pa.concat_arrays(held_ids), [t for part in held for t in part], digest)
            return pa.RecordBatch.from_pylist([{"block": number, **found}], schema=schema)

        size = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_chunks([t or "" for t in texts], chars):
                held_ids.append(batch.column(0).slice(a, b - a))
                held.append(texts[a:b])
                size += sum(len(t or "") for t in held[-1])
                if size >= chars:
                    yield block()
                    number, size, held_ids, held = number + 1, 0, [], []
        if held:
            yield block()

    return run


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pair, docs in zip(*(batch.column(n).to_pylist() for n in ("block", "pair", "pair_docs"))):
            pair = _unpacked(pair, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block, dtype=np.int64)), pa.array(np.arange(len(pair), dtype=np.int32)),
                                              pa.array(pair), pa.array(_unpacked(docs, "<u4").astype(np.int64))], names=["block", "at", "pair", "docs"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the corpus-wide counts of its pairs."""
    row = blocks.to_pylist()[0]
    arrays = {n: _unpacked(row[n], kind).astype(np.int64) for n, kind in KINDS.items()}
    count, best = np.zeros(len(arrays["pair"]), dtype=np.int64), np.zeros(len(arrays["pair"]), dtype=np.int64)
    at = counts["at"].to_numpy()
    count[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy().astype(np.int64)

    def summed(value: np.ndarray) -> np.ndarray:
        of_pairs = np.concatenate([[0], np.cumsum(value[arrays["unit_pair"]] * arrays["pair_times"])])
        of_unit = of_pairs[arrays["unit_start"][1:]] - of_pairs[arrays["unit_start"][:-1]]
        of_docs = np.concatenate([[0], np.cumsum(of_unit[arrays["unit"]] * arrays["unit_times"])])
        return of_docs[arrays["doc_start"][1:]] - of_docs[arrays["doc_start"][:-1]]

    columns = {n: pa.array(row[n], pa.int64()) for n in PER_DOC[:-1]}
    return pa.table(columns | {"n_best": pa.array(summed(best)), "count_sum": pa.array(summed(count)), "groups": pa.array(row["groups"], pa.string())})


def align_tokens(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    Each text with a space before it is encoded by a byte-level vocabulary (A, ``path_a``) and by a vocabulary of pieces that adds
    the space itself (B, ``path_b``). Where tokens of both end at the same byte the text is cut into groups:
    ``groups`` is ``a1,a2|b1;a3|b2`` (with ``digest`` its sha256 in hex). Every A-B pair of tokens in a group is a link. The count of a
    pair of ids is the number of rows that hold it linked; ``count_sum`` adds it up over the links, and ``n_best``
    counts links whose pair has its A id's highest count, ties included.

    A task aligns its texts in blocks and writes for each block the units of text it is made of, the pairs of each unit, and
    how many of its documents hold each pair. Only (block, pair) rows are shuffled: first to sum up the counts, then to
    bring them back to their blocks. Texts and tokens are not. No pair's rows outnumber the blocks, so no key is hot.

    Null and empty texts, and texts that either vocabulary doesn't give back byte by byte, have no tokens: zeros and the
    empty string. Null doc_id: kept. Repeated rows each count as documents. An empty table gives no rows; other columns
    are ignored. A text is held whole by its task; a block ends after ``block_chars``.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    blocks = written(rows.mapInArrow(_blocks(path_a, path_b, digest, block_chars), BLOCK), "token-blocks")
    pairs = blocks.select("block", "pair", "pair_docs").mapInArrow(_pairs_of_blocks, "block long, at int, pair long, docs long")
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    judged = counts.join(highest, F.shiftright("pair", 32) == highest["a"]).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    known = pairs.join(judged, "pair").select("block", "at", "n", "best")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored, RESULT)
