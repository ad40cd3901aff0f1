"""Vector and metadata search."""

from pyspark.sql import functions as F

from keepsake.functions.predicates import json_contains
from keepsake.functions.vectors import cosine
from keepsake.operators import lookups, retrieval, sign_bands, vector_index
from keepsake.operators.hooks import embed
from keepsake.plans import adapters as A
from keepsake.plans.catalog import query, time_text
from keepsake.session import fresh_path

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SIM = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"


def _rounded():
    return F.round("similarity", 6).alias("similarity")


def _plain(t):
    return t.read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("match_thoughts", f"""
  SELECT id, content, source, round(sim, 6) AS similarity, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM (SELECT *, {_SIM} AS sim FROM thoughts WHERE embedding IS NOT NULL)
  WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 10""", ("thoughts",))
def match_thoughts(t):
    found = retrieval.match_thoughts(A.thoughts(t), A.query_vector(t), threshold=0.3, k=10)
    return found.select("id", "content", F.get_json_object("metadata", "$.source").alias("source"),
                        _rounded(), time_text("created_at"))


@query("match_thoughts_filtered", f"""
  SELECT id, round(sim, 6) AS similarity FROM (SELECT *, {_SIM} AS sim FROM thoughts WHERE embedding IS NOT NULL AND lang = 'en')
  WHERE sim > 0.1 ORDER BY sim DESC, id LIMIT 10""", ("thoughts",))
def match_thoughts_filtered(t):
    found = retrieval.match_thoughts(A.thoughts(t), A.query_vector(t), threshold=0.1, k=10,
                                     filter={"lang": "en"}, promoted={"lang": "lang"})
    return found.select("id", _rounded())


@query("match_thoughts_nested_filter", f"""
  SELECT id, round(sim, 6) AS similarity FROM (SELECT *, {_SIM} AS sim FROM thoughts
    WHERE embedding IS NOT NULL AND list_contains(topics, 'en') AND type = 'reference')
  WHERE sim > 0.0 ORDER BY sim DESC, id LIMIT 20""", ("thoughts",))
def match_thoughts_nested_filter(t):
    found = retrieval.match_thoughts(A.thoughts(t), A.query_vector(t), threshold=0.0, k=20,
                                     filter={"topics": ["en"], "type": "reference"})
    return found.select("id", _rounded())


@query("match_siloed_sources", f"""
  SELECT id, source, round(sim, 6) AS similarity FROM (SELECT *, {_SIM} AS sim FROM thoughts
    WHERE embedding IS NOT NULL AND source IN ('src1', 'src2', 'src3'))
  WHERE sim > 0.0 ORDER BY sim DESC, id LIMIT 10""", ("thoughts",))
def match_siloed_sources(t):
    """Search within some sources only."""
    rows = lookups.from_source(A.thoughts(t), ["src1", "src2", "src3"])
    found = retrieval.match_thoughts(rows, A.query_vector(t), threshold=0.0, k=10)
    return found.select("id", F.get_json_object("metadata", "$.source").alias("source"), _rounded())


@query("match_many", """
  SELECT query_id, id, rank, round(sim, 6) AS similarity FROM (
    SELECT q.id AS query_id, t.id, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS sim,
           row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) DESC, t.id) AS rank
    FROM vectors q, vectors t
    WHERE list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) > 0.2) WHERE rank <= 5""", ("vectors",))
def match_many(t):
    """Every vector as a query against all vectors."""
    rows = A.vectors(t)
    return retrieval.match_many(rows, rows, threshold=0.2, k=5).select(
        "query_id", "id", F.col("rank").cast("bigint").alias("rank"), _rounded())


@query("similar_pairs", """
  , g AS (SELECT embedding, min(id) AS id, count(*) AS copies, min(created_at::DATE) AS d0, max(created_at::DATE) AS d1
          FROM vectors GROUP BY embedding)
  SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
         round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM g a JOIN g b ON a.id < b.id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3
    AND NOT (a.d0 = a.d1 AND b.d0 = b.d1 AND a.d0 = b.d0)
  UNION ALL SELECT id, id, copies, copies, 1.0 FROM g WHERE copies > 1 AND d0 <> d1""", ("vectors",))
def similar_pairs(t):
    return retrieval.similar_pairs(A.vectors(t), threshold=0.3).select("id_a", "id_b", "copies_a", "copies_b", _rounded())


@query("near_pairs_recall", """
  , g AS (SELECT embedding, min(id) AS id, min(created_at::DATE) AS d0, max(created_at::DATE) AS d1 FROM vectors GROUP BY embedding),
  p AS (SELECT a.id FROM g a JOIN g b ON a.id < b.id
        WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4
          AND NOT (a.d0 = a.d1 AND b.d0 = b.d1 AND a.d0 = b.d0)
        UNION ALL SELECT id FROM g WHERE d0 <> d1)
  SELECT count(*) AS pairs, 0::BIGINT AS wrong, true AS reached FROM p""", ("vectors",))
def near_pairs_recall(t):
    """Whether banded signs find nine tenths of the pairs that the exact comparison finds, and no other."""
    vectors = A.vectors(t)
    exact = retrieval.similar_pairs(vectors, threshold=0.4).select("id_a", "id_b", F.lit(1).alias("is_pair"), F.lit(0).alias("is_found"))
    found = sign_bands.near_pairs(vectors, threshold=0.4, recall=0.99, always=True).select(
        "id_a", "id_b", F.lit(0).alias("is_pair"), F.lit(1).alias("is_found"))
    # As many tasks as are set: merged by their bytes, of which a pair has few, they would hold more groups than fit in memory.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    both = exact.unionByName(found).repartition(tasks, "id_a", "id_b").groupBy("id_a", "id_b").agg(
        F.sum("is_pair").alias("is_pair"), F.sum("is_found").alias("is_found"))
    return both.agg(
        F.coalesce(F.sum("is_pair"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.greatest(F.col("is_found") - F.col("is_pair"), F.lit(0))), F.lit(0)).alias("wrong"),
        (F.coalesce(F.sum("is_found"), F.lit(0)) >= 0.9 * F.coalesce(F.sum("is_pair"), F.lit(0))).alias("reached"))


@query("vector_copies", """
  SELECT id, min(id) OVER (PARTITION BY embedding) AS representative FROM vectors""", ("vectors",))
def vector_copies(t):
    return retrieval.vector_copies(A.vectors(t))


@query("novelty", """
  SELECT a.id, round(1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS novelty
  FROM vectors a JOIN vectors b ON a.id <> b.id GROUP BY a.id""", ("vectors",))
def novelty(t):
    """Distance of every vector to its nearest neighbour."""
    return retrieval.novelty(A.vectors(t), n=None).select("id", F.round("novelty", 6).alias("novelty"))


@query("novelty_of_a_week", """
  , w AS (SELECT * FROM vectors WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15')
  SELECT a.id, round(1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS novelty
  FROM w a JOIN w b ON a.id <> b.id GROUP BY a.id ORDER BY novelty DESC, a.id LIMIT 3""", ("vectors",))
def novelty_of_a_week(t):
    return retrieval.novelty(A.vectors(t), "2024-01-08", "2024-01-15", n=3).select("id", F.round("novelty", 6).alias("novelty"))


@query("match_documents", f"""
  SELECT doc_id, arg_max(position, (sim, -position)) AS position, round(max(sim), 6) AS similarity
  FROM (SELECT vec_id // 5 AS doc_id, vec_id % 5 AS position, {_SIM} AS sim FROM embeddings)
  WHERE sim > 0.0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
  GROUP BY doc_id ORDER BY max(sim) DESC, doc_id LIMIT 10""")
def match_documents(t):
    """Vectors as chunks, five to a document."""
    vectors = t.read("embeddings")
    chunks = vectors.select(F.floor(F.col("vec_id") / 5).alias("doc_id"), F.pmod("vec_id", F.lit(5)).alias("position"), "embedding")
    docs = t.read("documents").select(F.col("doc_id").alias("id"), "lang")
    return retrieval.match_documents(docs, chunks, A.query_vector(t), F.col("lang") == "en", threshold=0.0, k=10).select(
        "doc_id", "position", _rounded())


_INDEXES: dict[tuple[str, str], vector_index.VectorIndex] = {}  # (application, tables) -> stored index


def _index(t):
    """The stored index over all vectors, built when first asked for."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        _INDEXES[key] = vector_index.build_index(A.vectors(t), fresh_path(t.spark, "vector-index"))
    return _INDEXES[key]


@query("match_thoughts_ann")
def match_thoughts_ann(t):
    """Search of a stored index; ``indexed_recall`` measures it against the exact search."""
    return vector_index.match_indexed(t.spark, _index(t), A.query_vector(t), k=10, threshold=0.2).select("id", _rounded())


@query("indexed_recall", """
  , s AS (SELECT q.id AS query_id, t.id, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS sim
          FROM vectors q, vectors t WHERE q.id < 100),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM s)
  SELECT count(DISTINCT query_id) AS queries, count(*) AS expected, true AS reached FROM r WHERE n <= 10""", ("vectors",))
def indexed_recall(t):
    """Whether the stored index finds nine tenths of the ten nearest vectors of a hundred questions."""
    vectors = A.vectors(t)
    asked = vectors.where("id < 100").select("id", "embedding")
    exact = retrieval.match_many(asked, vectors, threshold=-2.0, k=10)
    found = vector_index.match_many_indexed(_index(t), asked, k=10, threshold=-2.0).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("expected"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@query("cosine_by_label", f"""
  SELECT label, count(*) AS n, round(avg({_SIM}), 6) AS avg_similarity FROM vectors GROUP BY label""", ("vectors",))
def cosine_by_label(t):
    """The column form of cosine similarity inside an aggregate."""
    q = F.array(*[F.lit(x) for x in A.query_vector(t)])
    return A.vectors(t).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine("embedding", q)), 6).alias("avg_similarity"))


@query("metadata_filter", """
  SELECT event_id, user_id FROM events WHERE regexp_matches(props, '"k": 69[,}]')""")
def metadata_filter(t):
    return t.read("events").where(json_contains("props", {"k": 69})).select("event_id", "user_id")


@query("chunk_documents", """
  WITH RECURSIVE
  cuts AS (
    SELECT doc_id, 0 AS step, '' AS piece, text AS rest FROM documents WHERE text <> ''
    UNION ALL
    SELECT doc_id, step + 1, left(rest, size), substring(rest, size + 1) FROM (
      SELECT *, CASE WHEN length(rest) <= 800 THEN length(rest)
                     WHEN contains(substring(rest, 2, 800), chr(10)) THEN 802 - instr(reverse(substring(rest, 2, 800)), chr(10))
                     ELSE 800 END AS size
      FROM cuts WHERE rest <> ''))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INTEGER AS position, trim(piece, chr(10)) AS content
  FROM cuts WHERE trim(piece, chr(10)) <> ''""")
def chunk_documents(t):
    """Every document cut into chunks; the SQL cuts one after the other at the last line break within reach."""
    return retrieval.chunk_documents(_plain(t), 800)


@query("chunk_coverage", """
  SELECT doc_id, length(replace(text, chr(10), ''))::BIGINT AS characters FROM documents
  WHERE trim(text, chr(10)) <> ''""")
def chunk_coverage(t):
    """Chunks hold every character of their document but the line breaks between them."""
    chunks = retrieval.chunk_documents(_plain(t), 800)
    size = F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return chunks.groupBy("doc_id").agg(F.sum(size).alias("characters"))


@query("embed_documents", r"""
  SELECT doc_id, CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN 64 END AS dim,
         CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN 1.0::DOUBLE END AS norm FROM documents""")
def embed_documents(t):
    """Default (hashing) embedder over whole documents: the vectors are unit length."""
    docs = embed(t.read("documents").select("doc_id", "text"), text="text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return docs.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))
