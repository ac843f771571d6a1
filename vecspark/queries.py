"""The core queries: (spark, sf_dir) -> DataFrame over whole tables, each with
equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import tables
from vecspark.functions import text, vectors
from vecspark.operators import deletes, orphans, paging, search, stats
from vecspark.plans import ingest, requests

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_DIM = 64


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- references to records that do not exist -------------------------------

_P4_SQL = """
WITH ids AS (SELECT lower(trim(document_id)) k, min(created_at) created_at FROM store_documents GROUP BY 1),
md AS (SELECT DISTINCT lower(trim(content_md5)) k FROM store_documents WHERE content_md5 IS NOT NULL),
rm AS (SELECT DISTINCT lower(trim(document_id)) k FROM removed_documents),
inc AS (SELECT DISTINCT lower(trim(document_id)) k FROM incoming_batches),
pt AS (SELECT DISTINCT point_id, lower(trim(document_id)) d, lower(trim(content_md5)) m,
  CAST(('0x' || substr(replace(substr(point_id, 4), '-', ''), 1, 12)) AS BIGINT)::DOUBLE ms FROM points),
refs AS (
  SELECT 'points' ref_table, point_id row_key, d k, ms FROM pt WHERE d IS NOT NULL
  UNION SELECT 'search_results', result_id, lower(trim(document_id)), epoch_us(searched_at) / 1000.0
  FROM search_results WHERE document_id IS NOT NULL),
found AS (
  SELECT ref_table, 'document_id' ref_field, row_key,
    CASE WHEN ids.k IS NOT NULL THEN 'late' WHEN rm.k IS NOT NULL THEN 'removed'
         WHEN inc.k IS NOT NULL THEN 'pending' ELSE 'missing' END ref_status, ms
  FROM refs LEFT JOIN ids USING (k) LEFT JOIN rm USING (k) LEFT JOIN inc USING (k)
  WHERE ids.k IS NULL OR ids.created_at * 1000.0 > ms
  UNION ALL SELECT 'points', 'content_md5', point_id, 'missing', ms FROM pt
  WHERE m IS NOT NULL AND m NOT IN (SELECT k FROM md)),
rows AS (SELECT DISTINCT ref_table, ref_field, row_key, ref_status,
  strftime(make_timestamp(CAST(floor(ms) AS BIGINT) * 1000), '%Y-%m') year_month FROM found)
"""


@query(_P4_SQL + "SELECT * FROM rows")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        *(_table(spark, d, t) for t in
          ("points", "search_results", "store_documents", "removed_documents", "incoming_batches"))
    )


@query(_P4_SQL + "SELECT ref_table, ref_field, ref_status, year_month, count(*) orphans FROM rows GROUP BY ALL")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


# --- exact search -----------------------------------------------------------

_COS = "list_cosine_similarity(embedding::DOUBLE[], q.v)"
_Q0 = "WITH q AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0)"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("vec_id").alias("document_id"), "embedding", "label"
    )


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("source").alias("source_id")
    )


def _vector(points: DataFrame, vec_id: int) -> list[float]:
    rows = points.where(F.col("point_id") == vec_id).select("embedding").limit(1).collect()
    return list(rows[0][0])


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("point.point_id").alias("vec_id"), F.col("document.source_id").alias("source"),
        F.round("relevance_score", 5).alias("score"),
    )


@query(f"""{_Q0}, t AS (SELECT vec_id, {_COS} s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 5)
SELECT vec_id, source, round(s, 5) score FROM t JOIN documents ON doc_id = vec_id""")
def vector_search_topk(spark: SparkSession, d: str) -> DataFrame:
    points = _embeddings(spark, d)
    return _hits(search.search(points, _corpus(spark, d), _vector(points, 0), 5))


_USABLE = """len({c}) = 64 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter({c}, lambda x: x <> 0)) > 0"""


@query(f"""WITH p AS (SELECT DISTINCT point_id, document_id, embedding FROM points WHERE {_USABLE.format(c='embedding')}),
q AS (SELECT embedding::DOUBLE[] v FROM p ORDER BY point_id LIMIT 1),
t AS (SELECT point_id, document_id, {_COS} s FROM p, q ORDER BY s DESC, point_id LIMIT 200)
SELECT point_id, round(s, 5) score FROM t JOIN store_documents USING (document_id)""")
def search_with_orphans(spark: SparkSession, d: str) -> DataFrame:
    """The limit comes before the join: points whose document does not exist use up places."""
    v = F.col("embedding")
    points = _points(spark, d).select("point_id", "document_id", "embedding").where(
        (F.size(v) == _DIM) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    ).distinct()
    first = points.orderBy("point_id").first()["embedding"]
    found = search.search(points, _store(spark, d), list(first), 200)
    return found.select("point.point_id", F.round("relevance_score", 5).alias("score"))


@query(f"""{_Q0}, e AS (SELECT vec_id, embedding FROM embeddings
  UNION ALL SELECT -1, list_transform(range({_DIM}), lambda x: 0.0::FLOAT)),
t AS (SELECT vec_id, CASE WHEN vec_id = -1 THEN 'nan'::DOUBLE ELSE {_COS} END s FROM e, q ORDER BY s DESC, vec_id LIMIT 3)
SELECT vec_id, round(s, 5) score FROM t""")
def search_zero_vector(spark: SparkSession, d: str) -> DataFrame:
    """A zero vector scores NaN, which counts as largest."""
    points = _embeddings(spark, d)
    zero = spark.range(1).select(
        F.lit(-1).cast("long").alias("point_id"), F.lit(-1).cast("long").alias("document_id"),
        F.array_repeat(F.lit(0.0).cast("float"), _DIM).alias("embedding"), F.lit(None).cast("int").alias("label"),
    )
    best = search.top_k(points.unionByName(zero), _vector(points, 0), 3)
    return best.select(F.col("point_id").alias("vec_id"), F.round("relevance_score", 5).alias("score"))


@query(f"""WITH r AS (SELECT request_id, query_vector::DOUBLE[] v, CASE WHEN top_k > 0 THEN top_k ELSE 5 END k
  FROM search_requests WHERE {_USABLE.format(c='query_vector')}),
p AS (SELECT DISTINCT point_id, embedding::DOUBLE[] e FROM points WHERE {_USABLE.format(c='embedding')}),
s AS (SELECT request_id, point_id, k, list_cosine_similarity(e, v) s FROM r, p),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, point_id)::INT rank_no FROM s)
SELECT request_id, rank_no, point_id, round(s, 5) score FROM t WHERE rank_no <= k""")
def batch_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """All requests that bring a vector, against all points."""
    got = search.batch_top_k(_table(spark, d, "points"), _table(spark, d, "search_requests"), dim=_DIM)
    return got.select("request_id", "rank_no", "point_id", F.round("relevance_score", 5).alias("score"))


@query(f"""SELECT vec_id, round({_COS}, 5) score FROM embeddings,
(SELECT list_transform(range({_DIM}), lambda x: 1.0::DOUBLE) v) q""")
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every vector against the all-ones vector."""
    return _table(spark, d, "embeddings").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal([1.0] * _DIM)), 5).alias("score")
    )


# --- lookups, pages and counts ------------------------------------------------

_STORE_COLS = "document_id, name, content, content_md5, source_id, chunk_index, is_chunk, total_tokens, metadata, created_at, updated_at"


def _store(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "store_documents")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "points")


@query(f"SELECT {_STORE_COLS} FROM store_documents WHERE document_id = (SELECT max(document_id) FROM store_documents)")
def retrieve_document(spark: SparkSession, d: str) -> DataFrame:
    last = _store(spark, d).agg(F.max("document_id")).first()[0]
    return _store(spark, d).where(F.col("document_id") == last)


@query("SELECT DISTINCT point_id, document_id, content_md5, metadata FROM points WHERE point_id = (SELECT min(point_id) FROM points)")
def retrieve_point(spark: SparkSession, d: str) -> DataFrame:
    """A point without its embedding: the vector column is not read."""
    first = _points(spark, d).agg(F.min("point_id")).first()[0]
    return _points(spark, d).drop("embedding").where(F.col("point_id") == first).distinct()


_AFTER = "(SELECT min(document_id) FROM store_documents)"


@query(f"SELECT document_id, name FROM store_documents WHERE source_id = 'src-0001' AND document_id > {_AFTER} ORDER BY document_id LIMIT 21")
def list_documents_page(spark: SparkSession, d: str) -> DataFrame:
    after = _store(spark, d).agg(F.min("document_id")).first()[0]
    return paging.keyset(_store(spark, d), "document_id", after=after, source_id="src-0001").select("document_id", "name")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 400 ORDER BY vec_id DESC LIMIT 21")
def list_points_desc(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset(
        _table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", before=400, order="desc"
    )


@query("SELECT document_id, source_id FROM store_documents")
def list_all_documents(spark: SparkSession, d: str) -> DataFrame:
    """The rows that walking through all pages gives, as one sorted table."""
    return _store(spark, d).select("document_id", "source_id").orderBy("document_id")


@query("SELECT count(*) n FROM store_documents WHERE source_id = 'src-0001'")
def count_documents_filtered(spark: SparkSession, d: str) -> DataFrame:
    return paging.filtered(_store(spark, d), source_id="src-0001").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) n FROM embeddings GROUP BY label")
def count_points_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) n, count(embedding) embedded FROM points")
def count_embedded(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("embedding").isNotNull(), 1)).alias("embedded")
    )


@query("""SELECT batch_no, seq_no, EXISTS (SELECT 1 FROM store_documents s WHERE s.content_md5 = i.content_md5) present
FROM incoming_batches i""")
def content_exists(spark: SparkSession, d: str) -> DataFrame:
    known = _store(spark, d).select("content_md5").distinct().withColumn("present", F.lit(True))
    return _table(spark, d, "incoming_batches").join(known, "content_md5", "left").select(
        "batch_no", "seq_no", F.coalesce("present", F.lit(False)).alias("present")
    )


@query("SELECT * FROM manifest ORDER BY name LIMIT 1")
def manifest_receive(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_manifest(_table(spark, d, "manifest"))


# --- removals ---------------------------------------------------------------

_P = "DISTINCT point_id, document_id, content_md5"


@query(f"""SELECT {_P} FROM points WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM removed_documents)""")
def remove_points_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Points that stay when all logged removals are applied."""
    gone = _table(spark, d, "removed_documents").select("document_id")
    return _points(spark, d).select("point_id", "document_id", "content_md5").join(gone, "document_id", "left_anti").distinct()


@query("SELECT document_id, content_md5 FROM store_documents WHERE document_id NOT IN (SELECT document_id FROM removed_documents)")
def remove_documents(spark: SparkSession, d: str) -> DataFrame:
    gone = _table(spark, d, "removed_documents").select("document_id")
    return _store(spark, d).select("document_id", "content_md5").join(gone, "document_id", "left_anti")


@query(f"""SELECT {_P} FROM points WHERE NOT coalesce(document_id = (SELECT min(document_id) FROM points)
  OR content_md5 = (SELECT max(content_md5) FROM points) OR point_id = (SELECT max(point_id) FROM points), false)""")
def remove_many_or(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    low, md5, last = p.agg(F.min("document_id"), F.max("content_md5"), F.max("point_id")).first()
    return p.where(~deletes.any_in(document_id=[low], content_md5=[md5], point_id=[last])).select(
        "point_id", "document_id", "content_md5"
    ).distinct()


@query("""SELECT p.point_id FROM (SELECT DISTINCT point_id, document_id, content_md5 FROM points) p
JOIN store_documents s ON s.document_id = p.document_id WHERE p.content_md5 <> s.content_md5""")
def outdated_points(spark: SparkSession, d: str) -> DataFrame:
    """Points made from other content than their document has now."""
    now = _store(spark, d).select("document_id", F.col("content_md5").alias("now_md5"))
    return _points(spark, d).select("point_id", "document_id", "content_md5").distinct().join(now, "document_id").where(
        F.col("content_md5") != F.col("now_md5")
    ).select("point_id")


@query("SELECT count(*) n FROM store_documents WHERE NOT (source_id = 'src-0001' AND content_md5 <> 'x') OR source_id IS NULL")
def remove_outdated_count(spark: SparkSession, d: str) -> DataFrame:
    gone = deletes.outdated("src-0001", "x", key="source_id")
    return _store(spark, d).where(~gone).agg(F.count(F.lit(1)).alias("n"))


# --- text functions -----------------------------------------------------------

_WS = r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_strip_sql('text')}) content_md5 FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.content_md5(F.col("text")).alias("content_md5"))


@query(f"SELECT document_id, md5({_strip_sql('content')}) = content_md5 fresh FROM store_documents")
def hash_is_fresh(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).select(
        "document_id", (text.content_md5(F.col("content")) == F.col("content_md5")).alias("fresh")
    )


@query(f"""SELECT batch_no, seq_no, document_id FROM incoming_batches i
WHERE content IS NOT NULL AND {_strip_sql('content')} <> ''
  AND md5({_strip_sql('content')}) NOT IN (SELECT content_md5 FROM store_documents WHERE content_md5 IS NOT NULL)""")
def dedupe_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Incoming documents, hashed anew, that are not stored yet; equal new ones
    all stay."""
    clean = ingest.sanitized(_table(spark, d, "incoming_batches"), strict=False)
    return ingest.not_stored(clean, _store(spark, d)).select("batch_no", "seq_no", "document_id")


@query(f"""SELECT document_id, coalesce(nullif({_strip_sql('name')}, ''),
  substring(split_part({_strip_sql('content')}, chr(10) || chr(10), 1), 1, 36)) name,
  md5({_strip_sql('content')}) content_md5 FROM incoming_batches
WHERE content IS NOT NULL AND {_strip_sql('content')} <> ''""")
def sanitize_documents(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sanitized(_table(spark, d, "incoming_batches"), strict=False).select("document_id", "name", "content_md5")


@query(f"SELECT doc_id, substring(split_part({_strip_sql('text')}, chr(10) || chr(10), 1), 1, 36) name FROM documents")
def default_name_36(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.default_name(F.col("text")).alias("name"))


@query("SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 28) name, length(text)::INT content_length FROM documents")
def default_name_28(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(
        "doc_id", text.first_line_name(F.col("text")).alias("name"), F.length("text").alias("content_length")
    )


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, p, unnest(range(0, ((len(p) - 1) // 20) + 1)) k FROM l)
SELECT doc_id, k::INT chunk_index, array_to_string(p[k * 20 + 1 : k * 20 + 20], chr(10)) content,
  (len(p) > 20) is_chunk FROM c""")
def chunk_by_lines(spark: SparkSession, d: str) -> DataFrame:
    cut = _table(spark, d, "documents").where("text is not null").select(
        "doc_id", text.lines_chunks(F.col("text"), 20).alias("chunks")
    )
    return cut.select(
        "doc_id", F.posexplode("chunks").alias("chunk_index", "content"), (F.size("chunks") != 1).alias("is_chunk")
    )


@query("""SELECT request_id, coalesce(length(query) % 4 = 0 AND regexp_full_match(query, '[A-Za-z0-9+/]+={0,2}'), false) like_base64
FROM search_requests""")
def is_base64(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "search_requests").select("request_id", text.is_base64(F.col("query")).alias("like_base64"))


@query(f"""WITH r AS (SELECT request_id, query, lower({_strip_sql('encoding')}) h, coalesce(len(query_vector), 0) > 0 given,
  coalesce(length(query) % 4 = 0 AND regexp_full_match(query, '[A-Za-z0-9+/]+={{0,2}}')
    AND (length(query) // 4) * 3 - (length(query) - length(rtrim(query, '='))) = 256, false) b64 FROM search_requests)
SELECT request_id, CASE WHEN given THEN 'vector' WHEN coalesce(query, '') = '' THEN 'invalid' WHEN h = 'vector' THEN 'invalid'
  WHEN h = 'base64' THEN CASE WHEN b64 THEN 'base64' ELSE 'invalid' END
  WHEN coalesce(h NOT IN ('plaintext', 'base64', 'vector'), true) AND b64 THEN 'base64' ELSE 'embed' END route FROM r""")
def request_routes(spark: SparkSession, d: str) -> DataFrame:
    return requests.dispatch(_table(spark, d, "search_requests")).select("request_id", "route")


@query("""WITH r AS (SELECT request_id, query, query_vector, coalesce(len(query_vector), 0) > 0 given,
  lower(trim(encoding)) h, coalesce(length(query) % 4 = 0 AND regexp_full_match(query, '[A-Za-z0-9+/]+={0,2}')
    AND (length(query) // 4) * 3 - (length(query) - length(rtrim(query, '='))) = 256, false) b64 FROM search_requests)
SELECT request_id, CASE WHEN given THEN 'vector' ELSE 'base64' END route, CASE WHEN NOT given THEN query END coded,
  CASE WHEN given THEN query_vector::FLOAT[] END vector
FROM r WHERE given OR (coalesce(query, '') <> '' AND b64 AND coalesce(h NOT IN ('plaintext', 'vector'), true))""")
def request_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of requests that need no model: given ones, and those decoded
    from base64, which are shown coded again."""
    got = requests.dispatch(_table(spark, d, "search_requests")).where("route in ('vector', 'base64')")
    given = F.col("route") == "vector"
    return got.select(
        "request_id", "route", F.when(~given, vectors.vector_to_base64(F.col("vector"))).alias("coded"),
        F.when(given, F.col("vector").cast("array<float>")).alias("vector"),
    )


@query("SELECT vec_id, embedding FROM embeddings")
def base64_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = _table(spark, d, "embeddings").withColumn("b64", vectors.vector_to_base64(F.col("embedding")))
    return coded.select("vec_id", vectors.base64_to_vector(F.col("b64")).alias("embedding"))


@query("SELECT event_id, (props->>'$.k')::INT k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT document_id, coalesce(json_valid(metadata) AND json_type(CASE WHEN json_valid(metadata) THEN metadata END) = 'OBJECT', false) is_object
FROM store_documents""")
def metadata_is_object(spark: SparkSession, d: str) -> DataFrame:
    kind: Column = F.schema_of_variant(F.try_parse_json("metadata"))
    return _store(spark, d).select("document_id", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"))


@query("""WITH v AS (SELECT list_sort(list(value)) s, count(*) n FROM events WHERE value IS NOT NULL),
q AS (SELECT s, n, greatest(1.0, least(n::DOUBLE, 0.95 * (n + 1))) w FROM v)
SELECT count(*) queries, round(avg(value), 4) mean, round(quantile_cont(value, 0.5), 4) median, min(value) min, max(value) max,
  round(any_value(s[floor(w)::INT] + (s[least(n, floor(w)::INT + 1)] - s[floor(w)::INT]) * (w - floor(w))), 4) p95,
  0::BIGINT errors FROM events, q WHERE value IS NOT NULL""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    got = stats.query_times(_table(spark, d, "events"), "value")
    return got.select(
        "queries", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "min", "max",
        F.round("p95", 4).alias("p95"), "errors",
    )


@query(f"""SELECT document_id, md5({_strip_sql('content')}) content_md5, '{{}}' metadata FROM store_documents""")
def documents_to_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of documents before they are embedded."""
    return _store(spark, d).select(
        "document_id", text.content_md5(F.col("content")).alias("content_md5"), F.lit("{}").alias("metadata")
    )
