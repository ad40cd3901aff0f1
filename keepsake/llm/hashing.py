"""Words of many texts as arrays of 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SPACED_BYTES = np.ones(256, dtype=bool)
SPACED_BYTES[[*b" \t\n\x0b\x0c\r"]] = False
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 256)]] = True
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _LETTERS[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2**64, and of its inverse: ``n`` at least."""
    if len(_POWERS.get("up", ())) < n:
        n += n // 4
        for name, factor in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            table = np.full(n, factor, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, out=table)
    return _POWERS["up"], _POWERS["down"]


def range_sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each range of ``values`` that depends on its members and their order alone. Overwrites ``values``."""
    up, down = powers(len(values) + 1)
    values *= up[:len(values)]
    sums = np.cumsum(values, out=values)
    return (sums[stops - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * down[starts]


def cut_words(data: np.ndarray, inside: np.ndarray, letters: np.ndarray = _LETTERS) -> tuple[np.ndarray, ...]:
    """Starts, stops and 64-bit hashes of the runs of bytes whose entry in ``inside`` is true."""
    word = inside[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edges = np.concatenate([[0], edges])
    if len(edges) % 2:
        edges = np.concatenate([edges, [len(data)]])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return starts, stops, np.zeros(0, dtype=np.uint64)
    return starts, stops, mixed(range_sums(letters[data], starts, stops) + (stops - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words start (one more entry at the end).

    A word is a run of ASCII letters, digits and non-ASCII characters.
    """
    return _hashes([t.lower().encode("utf-8", "replace") for t in texts], WORD_BYTES, _LETTERS)


def spaced_word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words cut at ASCII white space, of which only A-Z are lower-cased."""
    return _hashes([t.encode("utf-8", "surrogatepass") for t in texts], SPACED_BYTES, _FOLDED)


def _hashes(parts: list[bytes], inside: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    starts, _, hashes = cut_words(data, inside, letters)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def text_chunks(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``chars`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
