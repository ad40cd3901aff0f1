"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import whole

WINDOW_WORDS = 8
DICTIONARY_BYTES = 2048
GRAM_CHARS = (5, 6, 7, 8)
TYPICAL_GRAMS = 400
TYPICAL_RATIO = 16.0
GAINS = (1, 2, 3, 4, 5, 7)
TRAINING_SPANS = 50_000
PRIMER = bytes([*range(1, 9), *range(14, 31)])  # every window starts with it, so each pays for its block header


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None  # of the features, bias last; None: nothing could be learned
    prior: float


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [(" " + " ".join(words[i:i + WINDOW_WORDS]) + " ").encode("utf-8", "replace")
            for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(dictionary: bytes):
    content = zstandard.ZstdCompressionDict(dictionary + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4)
    content.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress


def features(text: str, toxic, ordinary) -> np.ndarray:
    """From the bytes that each window is shorter under the toxic than under the ordinary dictionary."""
    cut = windows(text)
    if not cut:
        return np.zeros(2 * len(GAINS) + 2)
    gain = np.array([len(ordinary(PRIMER + w)) - len(toxic(PRIMER + w)) for w in cut])
    above = np.array([(gain >= g).sum() for g in GAINS])
    return np.concatenate([np.log1p(above), above / len(cut), [min(gain.max(), 12) / 4, gain.mean() / 4]])


def _gram_counts(texts: list[str]) -> tuple[Counter, int]:
    """Character grams of words, each word counted once per pair of neighbours, so copies don't count again."""
    seen = set()
    for text in texts:
        words = ["", *text.lower().split(), ""]
        seen.update(zip(words, words[1:], words[2:]))
    counts: Counter = Counter()
    for word, n in Counter(middle for _, middle, _ in seen).items():
        padded = f" {word} "
        for gram in {padded[i:i + k] for k in GRAM_CHARS for i in range(len(padded) - k + 1)}:
            counts[gram] += n
    return counts, max(1, len(seen))


def _typical(own: Counter, n_own: int, other: Counter, n_other: int) -> list[str]:
    """Grams that one side has far oftener than the other, the weightiest first."""
    found = []
    for gram, n in own.items():
        if n < 8:
            continue
        m = other.get(gram, 0)
        lift = np.log((n + 0.5) / n_own) - np.log((m + 0.5) / n_other)
        if lift > np.log(TYPICAL_RATIO) and lift > 3 * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)):
            found.append((lift * n, gram))
    return [gram for _, gram in sorted(found, reverse=True)][:TYPICAL_GRAMS]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """A dictionary trained on the spans typical of toxic text, and one on the spans typical of ordinary text.

    What both kinds share would cost the same bits in both lengths and only add noise to their difference.
    """
    counts = _gram_counts(toxic), _gram_counts(ordinary)
    return (_trained(_typical_spans(toxic, _typical(*counts[0], *counts[1]))),
            _trained(_typical_spans(ordinary, _typical(*counts[1], *counts[0]))))


def _typical_spans(texts: list[str], grams: list[str]) -> list[bytes]:
    if not grams:
        return []
    found = re.compile("|".join(map(re.escape, sorted(grams, key=lambda g: (-len(g), g))))).findall
    spans = []
    for text in texts:
        hits = found(" " + "  ".join(text.lower().split()) + " ")
        spans += ["".join(hits[i:i + 4]).encode("utf-8", "replace") for i in range(0, len(hits), 4)]
    return spans


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary of the spans; of more than ``TRAINING_SPANS`` those count that come first by a hash of place and span."""
    used = samples
    if len(samples) > TRAINING_SPANS:
        order = sorted(range(len(samples)), key=lambda i: (zlib.crc32(samples[i], zlib.crc32(i.to_bytes(8, "little"))), i))
        used = [samples[i] for i in sorted(order[:TRAINING_SPANS])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, used).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """Dictionaries from all texts; thresholds and weights calibrated on texts their dictionaries haven't seen."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", None, prior)
    rows, truth = [], []
    for part in (0, 1):
        a, b = map(_compressor, train_dictionaries(toxic[part::2], ordinary[part::2]))
        for texts, label in ((toxic[1 - part::2], 1), (ordinary[1 - part::2], 0)):
            rows += [features(t, a, b) for t in texts]
            truth += [label] * len(texts)
    x, y = np.column_stack([np.array(rows), np.ones(len(rows))]), np.array(truth, dtype=float)
    weight = np.where(y == 1, prior / len(toxic), (1 - prior) / len(ordinary)) * len(y)
    return Model(*train_dictionaries(toxic, ordinary), _logistic(x, y, weight), prior)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def scorer(model: Model):
    if model.weights is None:
        return lambda text: model.prior
    toxic, ordinary = _compressor(model.toxic), _compressor(model.ordinary)

    def score(text: str) -> float:
        z = float(np.append(features(text, toxic, ordinary), 1.0) @ model.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 1_000,
          sample_chars: int = 20_000) -> Model:
    """Fit on a bounded sample: the first ``sample_rows`` labelled rows of each class in the order of a hash of
    the id, of which texts over ``sample_chars`` are left out. Rows alike in id and text count as one; if ids have several texts,
    the first ``2 * sample_rows`` texts by a hash of id and text are taken. At most that much reaches the driver. The share of
    toxic rows is counted over all labels. A doc_id with several labels counts as toxic if any says so."""
    classes = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
               .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")))
    n = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = {side: [r["doc_id"] for r in classes.where(F.col("label") == side)
                     .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()] for side in (0, 1)}
    ids = docs.sparkSession.createDataFrame([(i, side) for side in picked for i in picked[side]], "id long, side int")
    rows = (docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"])  # at most 2 * sample_rows ids
            .where(F.length(docs["text"]) <= sample_chars)
            .select(docs["doc_id"].alias("id"), ids["side"], docs["text"].alias("text")).distinct()
            .orderBy(F.xxhash64("id", "text"), "id", "text").limit(2 * sample_rows).collect())
    rows = sorted((r["id"], r["side"], r["text"]) for r in rows)
    texts = {side: [t for _, s, t in rows if s == side] for side in (0, 1)}
    return fit(texts[1], texts[0], n.get(1, 0) / max(1, sum(n.values())))


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score``, 0 to 1, for each row. A null or empty text has no windows and gets the
    score of a text without any gain."""
    kept = docs.select(*[docs[c] for c in keep], whole(docs["text"]).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            scores = [score(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())],
                                             names=[*keep, "score"])

    schema = kept.select(*keep).schema.add("score", "double")
    return kept.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below ``threshold``, all their columns unchanged. A null or empty text stays
    unless toxic texts are the rule."""
    model = train(docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_training_fold(doc_id) -> object:
    """Rows whose crc32 of the id as text leaves a remainder other than 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2
