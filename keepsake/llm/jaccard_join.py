"""N-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import discard, whole, written
from keepsake.llm.components import joined_components
from keepsake.llm.hashing import mixed, spaced_word_hashes, text_chunks

FRAGMENTS = 8
FREQUENT_KEPT = 500_000
FREQUENT_LOCAL, FREQUENT_GLOBAL = 4, 16
WANTED_BITS = 24
BATCH_CHARS = 2_000_000
PIVOT_STEP = 8
_FACTORS = mixed(np.arange(101, 201, dtype=np.uint64))


def ngram_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence."""
    for a, b in text_chunks(texts):
        words, bounds = spaced_word_hashes(texts[a:b])
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for k in range(n):
            grams += words[k:k + len(grams)] * _FACTORS[k]
        grams = mixed(grams)
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low >= n:
                yield np.unique(grams[low:high - n + 1])
            elif high > low:
                yield mixed((words[low:high] * _FACTORS[50:50 + high - low]).sum(keepdims=True))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


@dataclass
class Order:
    """The global order of n-grams: by hash, but the most frequent ones last, the rarest of them first."""
    frequent: np.ndarray  # sorted
    rank: np.ndarray

    def keys(self, grams: np.ndarray) -> np.ndarray:
        out = grams >> np.uint64(1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
            known = self.frequent[at] == grams
            out[known] = np.uint64(1 << 63) + self.rank[at[known]]
        return out


def _batches(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work(ids, versions, texts)`` for each batch of documents, giving arrow arrays in the order of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, versions = batch.column(2).to_pylist(), batch.column(0), batch.column(1)
            for a, b in text_chunks(texts, BATCH_CHARS):
                yield pa.RecordBatch.from_arrays(work(ids.slice(a, b - a), versions.slice(a, b - a), texts[a:b]), names=names)

    return docs.mapInArrow(run, schema)


def _describe(n: int):
    """Rows of two kinds: a document with its set's id and size, or an n-gram that several sets of a batch hold."""

    def work(ids, versions, texts):
        sets = list(ngram_sets(texts, n))
        keys = [set_id(s) for s in sets]
        once = list({k: s for k, s in zip(keys, sets)}.values())
        grams, counts = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64),) * 2
        often = counts >= FREQUENT_LOCAL
        grams, counts = grams[often].view(np.int64), counts[often].astype(np.int64)
        none, few = pa.nulls(len(grams), pa.int64()), pa.nulls(len(keys), pa.int64())
        return [pa.concat_arrays([ids, none]), pa.concat_arrays([versions, none]), pa.concat_arrays([pa.array(keys, pa.int64()), none]),
                pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), none]),
                pa.concat_arrays([few, pa.array(grams)]), pa.concat_arrays([few, pa.array(counts)])]

    return work


def _prefixes(n: int, percent: int, order):
    """The first n-grams of each set in the global order, with their places: two sets that link share one of them."""

    def work(ids, versions, texts):
        sets = {set_id(s): s for s in ngram_sets(texts, n) if len(s)}
        grams, owners, sizes, places = [], [], [], []
        for key, s in sets.items():
            first = len(s) - (percent * len(s) + 99) // 100 + 1
            ranks = order.value.keys(s)
            at = np.argpartition(ranks, first - 1)[:first] if first < len(s) else np.arange(len(s))
            grams.append(s[at[np.argsort(ranks[at])]])
            owners.append(np.full(first, key, dtype=np.int64))
            sizes.append(np.full(first, len(s), dtype=np.int64))
            places.append(np.arange(first))
        if not grams:
            return [pa.array([], pa.int64())] * 4
        return [pa.array(np.concatenate(x).view(np.int64)) for x in (grams, owners, sizes, places)]

    return work


def _fragments(n: int, order, wanted):
    """The sets of the wanted texts, cut along the global order. Other texts aren't hashed."""

    def work(ids, versions, texts):
        rows = {}
        for s in ngram_sets([t for t, v in zip(texts, versions.to_pylist()) if _in(wanted.value, v)], n):
            if len(s) and (key := set_id(s)) not in rows:
                keys = order.value.keys(s)
                part = np.where(keys >> np.uint64(63) == 1, s % np.uint64(FRAGMENTS), keys >> np.uint64(60)).astype(np.int64)
                rows[key] = [(int(f), s[part == f].view(np.int64)) for f in np.unique(part)]
        flat = [(key, f, g) for key, parts in rows.items() for f, g in parts]
        ends = np.cumsum([0, *(len(g) for *_, g in flat)]).astype(np.int32)
        values = np.concatenate([g for *_, g in flat]) if flat else np.zeros(0, dtype=np.int64)
        return [pa.array([k for k, _, _ in flat], pa.int64()), pa.array([f for _, f, _ in flat], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]

    return work


def _in(bits: np.ndarray, key: int) -> bool:
    at = key % (1 << WANTED_BITS)
    return bool(bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1))


def _wanted(versions: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of texts; it only spares work, a text in it by accident changes nothing."""
    at = F.pmod(F.col("version"), F.lit(1 << WANTED_BITS))
    rows = versions.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(version, 64) as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (WANTED_BITS - 6), dtype=np.uint64)
    for r in rows:
        bits[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return bits


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, version`` (hash of the text), ``n_shingles,
    component_id``, the smallest doc_id that links lead to.

    Texts link when 100 * common n-grams >= ``percent`` * all n-grams of both. Words are cut at ASCII white space
    and lower-cased in A-Z; a text with fewer than n words has one shingle, one without words none and no links.

    Equal sets are one class, so copies are never compared. Two classes that link share an n-gram among their
    first ones in a global order that puts frequent n-grams last. Each n-gram's list is divided by bands of set sizes, a
    set being in its own band and the next, so that sets of too different sizes don't meet; and a pair must still be able to
    link if the places of the n-gram in both sets are those of their first common one. A list is worked off from its
    first entries, 1, 7, 56, ... at a time: such a pivot is compared with all later entries of other components. A
    list whose entries have come together needs no more pairs, and in the end every pair of a list is either
    compared or in one component, so no link is lost and no list is squared that holds one group. Compared
    pairs are counted by vertical partitioning: sets are cut into fragments along the global order, each fragment
    counts its partial overlaps by itself, and the counts are summed per pair. The first n-grams are counted
    first; most pairs can't link any more after that, and only the sets of the others are cut. New links join the components
    found so far, and tables that are no longer read are deleted.

    Null text: no words. Null doc_id: a row of its own that never names a component. Repeated rows are in one
    class and each give a row. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(whole(docs["text"])).alias("version"),
                         whole(docs["text"]).alias("text"))
    seen = written(_batches(source, _describe(n), "doc_id long, version long, sid long, size long, gram long, n long"), "sets")
    rows, grams = seen.where("gram is null").select("doc_id", "version", "sid", "size"), seen.where("gram is not null")
    frequent = (grams.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_GLOBAL)
                .orderBy(F.desc("n"), "gram").limit(FREQUENT_KEPT).toPandas())  # at most FREQUENT_KEPT n-grams
    found = frequent["gram"].to_numpy(dtype=np.int64).view(np.uint64)
    by_gram = np.argsort(found)
    order = spark.sparkContext.broadcast(Order(found[by_gram], (len(found) - by_gram).astype(np.uint64)))
    found = _batches(source, _prefixes(n, percent, order), "gram long, sid long, size long, place long").repartition("gram").distinct()
    shared = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("n > 1").drop("n")
    # A little over the largest ratio of sizes that can link, so that rounding never puts such a pair two bands apart.
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(100 / percent * (1 + 1e-9))))
    one_list = Window.partitionBy("gram", "band")
    banded = (shared.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own", F.col("band") == band)
              .withColumn("at", F.row_number().over(one_list.orderBy(F.xxhash64("sid"), "sid")))
              .withColumn("n", F.count(F.lit(1)).over(one_list)).withColumn("any", F.max("own").over(one_list)))
    lists = written(banded.where("n > 1 and any").drop("n", "any"), "lists")
    fronts = written(lists.groupBy("sid").agg(F.collect_set("gram").alias("front")), "fronts")
    roots, low, high = None, 0, 1
    while True:
        open_lists = lists.withColumn("root", F.col("sid"))
        if roots is not None:
            open_lists = lists.join(roots, lists["sid"] == roots["node"], "left").select(
                lists["*"], F.coalesce("root", "sid").alias("root"))
        mixed_lists = open_lists.groupBy("gram", "band").agg(F.max("at").alias("last"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        mixed_lists = mixed_lists.where((F.col("r0") != F.col("r1")) & (F.col("last") > low + (low > 0)))
        superseded = lists
        lists = written(open_lists.join(mixed_lists.select("gram", "band"), ["gram", "band"]).select(*lists.columns, "root"), "lists")
        discard(superseded)
        left = lists.select("gram", "band", *(F.col(c).alias(f"{c}_a") for c in ("sid", "size", "root", "place", "own", "at")))
        pivots = lists.where((F.col("at") > low) & (F.col("at") <= high)).select(
            "gram", "band", *(F.col(c).alias(f"{c}_b") for c in ("sid", "size", "root", "place", "own", "at")))
        most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        pairs = left.join(pivots, ["gram", "band"]).where(
            (F.col("at_a") > F.col("at_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("own_a") | F.col("own_b"))
            & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
            & ((100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))))
        pairs = pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), "size_a", "size_b").distinct()
        pairs = written(_possible(pairs, fronts, percent).select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes")), "pairs")
        if not pairs.isEmpty():
            needed = written(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "needed")
            linked = _linked(pairs, _pieces(source, rows, n, order, needed, few=low > 0), percent)
            if not linked.isEmpty():
                roots = joined_components(roots, linked)
            discard(needed, linked)
        elif lists.isEmpty():
            discard(pairs)
            break
        discard(pairs)
        lists, low, high = _without_root(lists), high, PIVOT_STEP * high
    discard(lists, fronts)
    classes = rows.withColumn("class", F.col("sid"))
    if roots is not None:
        classes = rows.join(roots, rows["sid"] == roots["node"], "left").select(rows["*"], F.coalesce("root", "sid").alias("class"))
    smallest = classes.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    joined = classes.join(smallest, "class", "left")
    return joined.select("doc_id", "version", F.col("size").alias("n_shingles"),
                         F.when(F.col("size") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest doc_id, all its columns unchanged; of rows alike in
    doc_id and text one, always the same. Documents without words are in no component and all stay. Rows without a doc_id can't name
    a component: one made of such rows only keeps each different text."""
    found = jaccard_components(docs, n, percent)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("id"), F.col("version").alias("of")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.xxhash64(whole(docs["text"])).alias("version"))
    met = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["version"] == kept["of"]), "left_semi")
    others = [F.col("row")[c] for c in docs.columns if c != "text"]
    alike = Window.partitionBy("doc_id", "version").orderBy(F.xxhash64(*others), F.to_json(F.struct(*others)))
    return met.withColumn("nth", F.row_number().over(alike)).where("nth = 1").select("row.*")


def _possible(pairs: DataFrame, fronts: DataFrame, percent: int) -> DataFrame:
    """The pairs that can still link once the first fragment, their first n-grams, is counted.

    Of the n-grams that two sets share, those among the first of the set whose first part ends earlier are among the
    first of the other too. So the rest of either set is all that can be added to what the first parts share.
    """
    one, two = fronts.toDF("a", "front_a"), fronts.toDF("b", "front_b")
    first = lambda size: size - F.ceil(percent * size / 100) + 1
    rest = F.greatest(F.col("size_a") - first(F.col("size_a")), F.col("size_b") - first(F.col("size_b")))
    most = F.size(F.array_intersect("front_a", "front_b")) + rest
    return pairs.join(one, "a").join(two, "b").where((100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b")))


def _without_root(lists: DataFrame) -> DataFrame:
    rows = lists.drop("root")
    rows.written_to = lists.written_to
    return rows


def _pieces(source: DataFrame, rows: DataFrame, n: int, order, needed: DataFrame, few: bool) -> DataFrame:
    """``sid, fragment, grams`` of the sets in ``needed``, cut from one text of each. With ``few``, as in all rounds but the first, the
    table is narrowed to these texts before it goes to Python."""
    texts = rows.join(needed, "sid").groupBy("sid").agg(F.min("version").alias("version")).select("version")
    wanted = source.sparkSession.sparkContext.broadcast(_wanted(texts))
    if few:
        source = source.join(texts, "version", "left_semi").select("doc_id", "version", "text")
    cut = _batches(source, _fragments(n, order, wanted), "sid long, fragment int, grams array<long>")
    return cut.join(needed, "sid", "left_semi")


def _linked(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. A set that several batches cut comes more than once, always alike: its fragments are
    counted by their largest overlap."""
    one = pieces.select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    two = pieces.select(F.col("sid").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = (pairs.join(one, "a").join(two, ["b", "fragment"])
               .select("a", "b", "sizes", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
               .groupBy("a", "b", "sizes", "fragment").agg(F.max("common").alias("common")))
    total = partial.groupBy("a", "b", "sizes").agg(F.sum("common").alias("common"))
    return written(total.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"), "links")
