"""Quality without gold labels: overlapping heuristics vote, expectation-maximisation weighs them, and their
posterior labels train a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import whole

BAD, GOOD, SILENT = 0, 1, 2
LABELLERS = ("symbols", "capitals", "bars", "exclamations", "stutter", "variety", "sentences", "word_length", "digits",
             "plain_words")
DIMENSIONS = 4096
KNOWN_WORDS = 200_000
KNOWN_CHARS = 64  # longer words are hashed anew each time


def _between(value: float, bad_above: float, good_below: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else SILENT


def votes(text: str, words: list[str], counts: Counter) -> list[int]:
    """One vote of each labeller. A text without words gets silence from all but the last two, which call it bad."""
    n, different = len(words), len(counts)
    if not n:
        return [SILENT] * (len(LABELLERS) - 2) + [BAD, BAD]
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum() + count[128:].sum() // 2, count[48:58].sum()
    letters = max(1, upper + lower)
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    marks = (count[ord(".")] + count[ord(",")]) / n
    variety = different / n
    plain = sum(k for w, k in counts.items() if w.strip(".,;:?()'\"").isalpha()) / n
    return [
        _between(count[[*b"#*$%&"]].sum() / n, 0.15, 0.02),
        _between(upper / letters, 0.3, 0.12),
        _between(count[ord("|")] / n, 0.1, 0.01),
        _between(count[ord("!")] / n, 0.15, 0.03),
        _between(stutter, 0.2, 0.05),
        SILENT if n < 30 else BAD if variety < 0.12 else GOOD if variety > 0.3 else SILENT,
        SILENT if n < 30 else GOOD if 0.03 < marks < 0.5 else BAD,
        _between(letters / n, 15.0, 10.0) if letters >= 2 * n else BAD,
        _between(digits / (letters + digits), 0.4, 0.1),
        BAD if plain < 0.65 else GOOD if plain > 0.85 else SILENT,
    ]


def _shape(word: str) -> str:
    """The kinds of all characters of a word, runs as one."""
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c.isascii() else "?"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


_SLOTS: dict[str, tuple[int, int]] = {}  # of this Python worker


def _slots(word: str) -> tuple[int, int]:
    found = _SLOTS.get(word)
    if found is None:
        if len(_SLOTS) > KNOWN_WORDS:
            _SLOTS.clear()
        found = (zlib.crc32(("shape " + _shape(word)).encode()) % DIMENSIONS,
                 zlib.crc32(("tail " + word[-3:]).encode("utf-8", "replace")) % DIMENSIONS)
        if len(word) <= KNOWN_CHARS:
            _SLOTS[word] = found
    return found


def hashed(words: list[str], counts: Counter) -> np.ndarray:
    """Word shapes, word ends and equal neighbours of a text as a hashed vector of length 1."""
    x = np.zeros(DIMENSIONS, dtype=np.float32)
    if not counts:
        return x
    slots = np.array([_slots(w) for w in counts])
    n = np.array(list(counts.values()), dtype=np.float64)
    for side in (0, 1):
        x += np.bincount(slots[:, side], weights=n, minlength=DIMENSIONS).astype(np.float32)
    x[zlib.crc32(b"same") % DIMENSIONS] += 4 * sum(map(str.__eq__, words, words[1:]))
    return np.sqrt(x) / np.float32(np.sqrt(x.sum()))


@dataclass
class Accuracies:
    """P(vote | class) of each labeller among the votes it casts: an array labeller x class (bad, good) x vote."""
    table: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes. Silence says nothing."""
        logs = np.concatenate([np.log(self.table), np.zeros((*self.table.shape[:2], 1))], axis=2)
        side = [np.log(p) + sum(logs[k, c, patterns[:, k]] for k in range(patterns.shape[1]))
                for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(side[0] - side[1], -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, belief: float = 0.02) -> Accuracies:
    """Reliabilities from agreement alone. Each labeller looks at one kind of fault, so at the start one objection
    outweighs several nods; that also fixes which of the two classes is the good one. ``belief``, a share of all
    documents, is the weight of the assumption that good texts are seldom objected to and bad ones by half."""
    cast = (patterns != SILENT).sum(axis=1)
    good = np.where(cast > 0, ((patterns == GOOD).sum(axis=1) + 0.5) / (cast + 1), 0.5)
    weight = np.where((patterns == BAD).any(axis=1), np.minimum(good, 0.2), good)
    assumed = belief * max(1.0, counts.sum()) * np.array([[0.5, 0.5], [0.02, 0.98]])
    for _ in range(steps):
        table = np.empty((patterns.shape[1], 2, 2))
        for c, w in ((0, 1 - weight), (1, weight)):
            mass = w * counts
            for k in range(patterns.shape[1]):
                seen = np.bincount(patterns[:, k], weights=mass, minlength=3)[:2] + assumed[c]
                table[k, c] = seen / seen.sum()
        prior = float(np.clip((weight * counts).sum() / max(1, counts.sum()), 0.01, 0.99))
        found = Accuracies(table, prior)
        before, weight = weight, found.posterior(patterns)
        if np.abs(weight - before).max() < 1e-9:
            break
    return found


def train_scorer(x: np.ndarray, target: np.ndarray, ridge: float = 1e-4, steps: int = 300, rate: float = 4.0) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps with momentum; bias last."""
    x = np.column_stack([x, np.ones(len(x), dtype=np.float32)])
    weights, move = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        move = 0.9 * move - rate * (x.T @ (p - target) / max(1, len(x)) + ridge * weights)
        weights += move
    return weights


def _encoded(found: list[int]) -> int:
    code = 0
    for v in found:
        code = code * 3 + v
    return code


def _decoded(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (codes[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``code``, ``n``: how many documents got each combination of votes. Counted over all documents; there are at
    most 3 ** labellers rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_encoded(votes(t, w := t.split(), Counter(w))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, type=pa.int64())], names=["code"])

    return docs.select(whole(docs["text"]).alias("text")).mapInArrow(run, "code long").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, sample_rows: int = 3_000, sample_chars: int = 20_000) -> tuple[Accuracies, np.ndarray] | None:
    """Reliabilities from the votes on all documents, and a scorer trained on a bounded sample: the first
    ``sample_rows`` different texts at most in the order of a hash, none over ``sample_chars``. Copies of a text, however many,
    count as one. At most that much reaches the driver."""
    patterns = np.array([tuple(r) for r in vote_patterns(docs).collect()], dtype=np.int64).reshape(-1, 2)
    if not len(patterns):
        return None
    found = expectation_maximisation(_decoded(patterns[:, 0]), patterns[:, 1].astype(float))
    text = whole(docs["text"])
    short = docs.where(F.length(text) <= sample_chars).select(text.alias("text"), F.xxhash64(text).alias("hash"))
    different = short.agg(F.approx_count_distinct("hash", 0.02)).first()[0]
    share = min(1.0, 2 * sample_rows / max(1, different))  # more than enough, so that only these are compared
    place = F.pmod("hash", F.lit(1 << 30))
    rows = short.where(place < int(share * (1 << 30))).distinct().orderBy(place, "text").limit(sample_rows)
    x, target = [], []
    for t in sorted(r["text"] for r in rows.collect()):
        words = t.split()
        counts = Counter(words)
        x.append(hashed(words, counts))
        target.append(votes(t, words, counts))
    if not x:
        return found, np.zeros(DIMENSIONS + 1)
    return found, train_scorer(np.array(x), found.posterior(np.array(target)))


def score_quality(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, n_words, posterior, score, kept`` for each row: what the weighted votes say (P(good)), what the
    linear scorer trained on them says, and whether that reaches ``threshold``.

    A null text is an empty one: no words, score 0, not kept. Repeated rows are scored alike; an empty table gives
    no rows; other columns are ignored.
    """
    model = fit(docs, **options)
    schema = "doc_id long, n_words long, posterior double, score double, kept boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weights = shared.value or (None, None)
        for batch in batches:
            size, score, pattern = [], [], []
            for t in batch.column(1).to_pylist():
                words = t.split()
                counts = Counter(words)
                size.append(len(words))
                pattern.append(votes(t, words, counts))
                z = float(hashed(words, counts) @ weights[:-1] + weights[-1])
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if words else 0.0)
            belief = found.posterior(np.array(pattern)) if pattern else []
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(belief, pa.float64()), pa.array(score, pa.float64()),
                pa.array([s >= threshold for s in score], pa.bool_())],
                names=["doc_id", "n_words", "posterior", "score", "kept"])

    return docs.select("doc_id", whole(docs["text"]).alias("text")).mapInArrow(run, schema)
