"""Queries that go through the public API: a store is filled with whole tables,
then its methods are called.  Each has equivalent SQL."""

from __future__ import annotations

import asyncio
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import embed, runtime, schema
from vecspark.engine import Engine
from vecspark.functions import chunk, ids, text, vectors
from vecspark.models import Document, Manifest, Point, SearchRequest, SearchResult
from vecspark.operators import deletes, paging
from vecspark.queries import _STORE_COLS, QUERIES, _strip_sql, _table, query
from vecspark.sources.store import Store
from vecspark.streaming.ingest import add_stream
from vecspark.tables import Database


class LetterCounts:
    """A model that SQL can repeat: how often some letters occur."""

    name, dimensions, letters = "letter-counts", 8, "aeinorst"

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in self.letters] for t in texts], np.float32).reshape(len(texts), -1)


def _counts_sql(c: str) -> str:
    return "[" + ", ".join(f"length({c}) - length(replace({c}, '{x}', ''))" for x in LetterCounts.letters) + "]::DOUBLE[]"


def _folder(spark: SparkSession) -> str:
    """A folder for a store, deleted when the process ends."""
    path = f"{runtime.shared_dir(spark)}/api-{uuid.uuid4().hex}"
    runtime._WRITTEN.append(runtime.Written(spark, path, None))
    return path


def _engine(spark: SparkSession) -> Engine:
    return Engine(_folder(spark), LetterCounts(), spark=spark)


#: The rows that a store takes: what must not be null is not.
_WHOLE = "content IS NOT NULL AND name IS NOT NULL AND content_md5 IS NOT NULL"
_DOCS = f"docs AS (SELECT {_STORE_COLS} FROM store_documents WHERE {_WHOLE})"
_PTS = ("pts AS (SELECT DISTINCT point_id, document_id, content_md5, embedding, metadata FROM points "
        "WHERE document_id IS NOT NULL AND content_md5 IS NOT NULL)")


def _filled(spark: SparkSession, d: str) -> Database:
    db = Database(Store(spark, _folder(spark), bloom_filters=True))
    db.touch()
    points = _table(spark, d, "points").where("document_id is not null and content_md5 is not null").distinct()
    db.store.commit(append={
        schema.DOCUMENTS: _table(spark, d, "store_documents").where(_WHOLE), schema.POINTS: points,
    })
    return db


def _row(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# --- stores, tables and manifests ---------------------------------------------


@query("SELECT unnest(['documents', 'manifest', 'points']) table_name")
def show_tables(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark)
    return spark.createDataFrame([(t,) for t in engine.db.show_table_names()], "table_name string")


@query("SELECT 'letter-counts' embedding_model, 8 embedding_dimensions, 'default' AS name, true second_is_error, true reopened")
def manifest_of_store(spark: SparkSession, d: str) -> DataFrame:
    """A store's manifest is made once and has to fit whoever opens it."""
    engine = _engine(spark)
    stored = engine.db.manifest.receive()
    try:
        engine.db.manifest.create(Manifest("other", 3))
        second = False
    except ValueError:
        second = True
    again = Engine(engine.db.store.root, LetterCounts(), spark=spark).manifest == stored
    return spark.createDataFrame(
        [(stored.embedding_model, stored.embedding_dimensions, stored.name, second, again)],
        "embedding_model string, embedding_dimensions int, name string, second_is_error boolean, reopened boolean",
    )


@query(f"WITH {_DOCS}, {_PTS} SELECT (SELECT count(*) FROM docs) documents, 0::BIGINT points, 0::BIGINT points_of_one")
def drop_points(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    db.points.drop(force=True)
    return _row(spark, documents=db.documents.count(), points=db.points.count(), points_of_one=db.points.count(document_id="x"))


@query(f"""WITH {_DOCS} SELECT document_id, content_md5 FROM docs
WHERE document_id NOT IN (SELECT document_id FROM removed_documents WHERE document_id IS NOT NULL)""")
def compacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Removals by keys, then a rewrite: the same rows in one part."""
    db = _filled(spark, d)
    gone = _table(spark, d, "removed_documents").select("document_id").where("document_id is not null")
    db.store.commit(remove={schema.DOCUMENTS: gone})
    db.store.compact(schema.DOCUMENTS)
    return db.documents.frame().select("document_id", "content_md5")


@query("SELECT unnest(['document_id', 'name', 'total', 'tags', 'vector']) AS name, unnest(['string', 'varchar(9)', 'bigint', 'array<string>', 'array<float>']) AS type, unnest([false, true, true, true, true]) nullable")
def struct_of_json_schema(spark: SparkSession, d: str) -> DataFrame:
    properties = {
        "document_id": {"type": "string"}, "name": {"type": "string", "maxLength": 9}, "total": {"type": "integer"},
        "tags": {"type": "array", "items": {"type": "string"}}, "vector": {"type": "array", "items": {"type": "number"}},
    }
    fields = schema.struct_from_json_schema({"properties": properties, "required": ["document_id"]})
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "name string, type string, nullable boolean")


# --- lookups, lists, counts ------------------------------------------------------


@query(f"WITH {_DOCS} SELECT document_id, {_strip_sql('name')} AS name, content, content_md5, chunk_index FROM docs WHERE document_id = (SELECT max(document_id) FROM docs)")
def documents_retrieve(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    found = db.documents.retrieve(db.documents.frame().agg(F.max("document_id")).first()[0])
    return spark.createDataFrame(
        [(found.document_id, found.name, found.content, found.content_md5, found.chunk_index)],
        "document_id string, name string, content string, content_md5 string, chunk_index int",
    )


@query(f"WITH {_DOCS} SELECT document_id, content_md5 FROM docs WHERE document_id IN (SELECT document_id FROM removed_documents)")
def documents_retrieve_many(spark: SparkSession, d: str) -> DataFrame:
    """Logged removals that are back in the store."""
    db = _filled(spark, d)
    wanted = [r[0] for r in _table(spark, d, "removed_documents").select("document_id").distinct().collect()]
    got = db.documents.retrieve_many(wanted)
    return spark.createDataFrame([(x.document_id, x.content_md5) for x in got], "document_id string, content_md5 string")


@query(f"WITH {_PTS} SELECT point_id, document_id, content_md5, false is_embedded FROM pts WHERE point_id = (SELECT min(point_id) FROM pts)")
def points_retrieve(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    found = db.points.retrieve(db.points.frame().agg(F.min("point_id")).first()[0])
    return spark.createDataFrame(
        [(found.point_id, found.document_id, found.content_md5, found.is_embedded)],
        "point_id string, document_id string, content_md5 string, is_embedded boolean",
    )


@query(f"""WITH {_DOCS}, p AS (SELECT document_id, row_number() OVER (ORDER BY document_id) r, count(*) OVER () n FROM docs WHERE source_id = 'src-0001')
SELECT document_id, n > 15 has_more FROM p WHERE r <= 15""")
def documents_list(spark: SparkSession, d: str) -> DataFrame:
    page = _filled(spark, d).documents.list(source_id="src-0001", limit=15)
    return spark.createDataFrame([(x.document_id, page.has_more) for x in page.data], "document_id string, has_more boolean")


@query(f"WITH {_DOCS} SELECT (row_number() OVER (ORDER BY document_id) - 1)::BIGINT AS position, document_id FROM docs WHERE source_id = 'src-0002'")
def documents_gen(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a source, page by page."""
    got = _filled(spark, d).documents.gen(source_id="src-0002", limit=500)
    return spark.createDataFrame([(i, x.document_id) for i, x in enumerate(got)], "position long, document_id string")


@query(f"""WITH {_PTS} SELECT (row_number() OVER (ORDER BY point_id DESC) - 1)::BIGINT AS position, point_id FROM pts
WHERE document_id = (SELECT document_id FROM pts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def points_gen_desc(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    most = db.points.frame().groupBy("document_id").count().orderBy(F.desc("count"), "document_id").first()[0]
    got = db.points.gen(document_id=most, order="desc", limit=1)
    return spark.createDataFrame([(i, x.point_id) for i, x in enumerate(got)], "position long, point_id string")


@query(f"""WITH {_DOCS}, {_PTS}, m AS (SELECT min(content_md5) m FROM docs)
SELECT (SELECT count(*) FROM docs) documents, (SELECT count(*) FROM docs, m WHERE content_md5 = m) same_content,
  (SELECT count(*) FROM pts) points, (SELECT count(*) FROM pts, m WHERE content_md5 = m) points_of_content, true known, false unknown""")
def counts_and_existence(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    md5 = db.documents.frame().agg(F.min("content_md5")).first()[0]
    return _row(
        spark, documents=db.documents.count(), same_content=db.documents.count(content_md5=md5), points=db.points.count(),
        points_of_content=db.points.count(content_md5=md5), known=db.documents.content_exists(md5), unknown=db.points.content_exists("none"),
    )


# --- removals -----------------------------------------------------------------------


@query(f"""WITH {_PTS}, x AS (SELECT min(document_id) d, max(content_md5) m, max(point_id) p FROM pts)
SELECT point_id FROM pts, x WHERE document_id <> d AND content_md5 <> m AND point_id <> p""")
def points_remove_many(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    low, md5, last = db.points.frame().agg(F.min("document_id"), F.max("content_md5"), F.max("point_id")).first()
    db.points.remove_many([last], document_ids=[low], content_md5s=[md5])
    return db.points.frame().select("point_id")


@query(f"""WITH {_PTS}, x AS (SELECT document_id d, min(content_md5) m FROM pts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT point_id FROM pts, x WHERE NOT (document_id = d AND content_md5 <> m) AND point_id <> (SELECT min(point_id) FROM pts)""")
def points_remove_outdated(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    most = db.points.frame().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("content_md5").alias("m")).orderBy(
        F.desc("n"), "document_id").first()
    first = db.points.frame().agg(F.min("point_id")).first()[0]
    db.points.remove_outdated(document_id=most["document_id"], content_md5=most["m"])
    db.points.remove(first)
    return db.points.frame().select("point_id")


@query(f"WITH {_DOCS} SELECT document_id FROM docs WHERE document_id <> (SELECT min(document_id) FROM docs)")
def documents_remove(spark: SparkSession, d: str) -> DataFrame:
    db = _filled(spark, d)
    db.documents.remove(db.documents.frame().agg(F.min("document_id")).first()[0])
    db.documents.remove("none")
    return db.documents.frame().select("document_id")


@query(f"""WITH {_DOCS}, {_PTS}, gone AS (SELECT DISTINCT document_id FROM removed_documents WHERE document_id IS NOT NULL)
SELECT 'documents' kind, document_id id FROM docs WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'points', point_id FROM pts WHERE document_id NOT IN (SELECT document_id FROM gone)""")
def engine_remove(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their points leave in one commit."""
    engine = Engine(_filled(spark, d).store.root, LetterCounts(), spark=spark)
    engine.remove([r[0] for r in _table(spark, d, "removed_documents").where("document_id is not null").select("document_id").distinct().collect()])
    return engine.db.documents.frame().select(F.lit("documents").alias("kind"), F.col("document_id").alias("id")).unionByName(
        engine.db.points.frame().select(F.lit("points").alias("kind"), F.col("point_id").alias("id")))


# --- adding and searching -------------------------------------------------------------

_LINES = 20
_CHUNKS = f"""t AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL AND {_strip_sql('text')} <> ''),
l AS (SELECT doc_id, lang, string_split(text, chr(10)) p FROM t),
k AS (SELECT doc_id, lang, p, unnest(range(0, ((len(p) - 1) // {_LINES}) + 1)) k FROM l),
c AS (SELECT doc_id, lang, array_to_string(p[k * {_LINES} + 1 : k * {_LINES} + {_LINES}], chr(10)) content FROM k),
chunks AS (SELECT doc_id, lang, content, md5({_strip_sql('content')}) md5 FROM c WHERE {_strip_sql('content')} <> '')"""


def _contents(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.where(~text.is_blank(F.col("text"))).select(F.col("text").alias("content"), F.lit("").alias("name"), "lang")


@query(f"""WITH {_CHUNKS} SELECT (SELECT count(*) FROM chunks WHERE lang = 'en') first_created,
  (SELECT count(*) FROM chunks WHERE md5 NOT IN (SELECT md5 FROM chunks WHERE lang = 'en')) created_documents,
  (SELECT count(*) FROM chunks WHERE md5 IN (SELECT md5 FROM chunks WHERE lang = 'en')) ignored_documents,
  (SELECT count(*) FROM chunks WHERE md5 NOT IN (SELECT md5 FROM chunks WHERE lang = 'en')) created_points, true success""")
def engine_add(spark: SparkSession, d: str) -> DataFrame:
    """English documents, then all: what is stored is passed over."""
    engine, docs = _engine(spark), _contents(spark, d)
    first = engine.add(docs.where("lang = 'en'").drop("lang"), lines_per_chunk=_LINES, tokens_per_chunk=1 << 30)
    got = engine.add(docs.drop("lang"), lines_per_chunk=_LINES, tokens_per_chunk=1 << 30)
    return _row(
        spark, first_created=first["created_documents"], created_documents=got["created_documents"],
        ignored_documents=got["ignored_documents"], created_points=got["created_points"], success=got["success"],
    )


@query(f"""WITH {_CHUNKS} SELECT md5 content_md5, {_counts_sql('any_value(content)')} embedding FROM chunks GROUP BY 1""")
def engine_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of all chunks, each content once, with their vectors."""
    engine = _engine(spark)
    engine.add(_contents(spark, d).drop("lang"), lines_per_chunk=_LINES, tokens_per_chunk=1 << 30, dedupe_within_batch=True)
    return engine.db.points.frame().select("content_md5", F.col("embedding").cast("array<double>").alias("embedding"))


_ASKED = "the nearest shelters stand in the rain"


@query(f"""WITH {_CHUNKS}, u AS (SELECT md5, any_value(content) content FROM chunks GROUP BY 1),
s AS (SELECT md5, list_cosine_similarity({_counts_sql('content')}, {_counts_sql(f"'{_ASKED}'")}) s FROM u WHERE content SIMILAR TO '(.|\\n)*[{LetterCounts.letters}](.|\\n)*')
SELECT row_number() OVER (ORDER BY round(s, 4) DESC) AS rank_no, round(s, 4) score FROM s ORDER BY s DESC LIMIT 10""")
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """A text, embedded by the model, against all chunks of all documents."""
    engine = _engine(spark)
    some = F.col("content").rlike(f"[{LetterCounts.letters}]")  # a vector of zeros has no cosine
    engine.add(_contents(spark, d).where(some).drop("lang"), lines_per_chunk=_LINES, tokens_per_chunk=1 << 30, dedupe_within_batch=True)
    zero = engine.db.points.frame().where(~F.exists("embedding", lambda x: x != 0)).select("point_id")
    engine.db.store.commit(remove={schema.POINTS: zero})
    hits = asyncio.run(engine.asearch(SearchRequest(_ASKED, 10)))
    found = [SearchResult.from_search_result(h) for h in hits]
    assert all(h.point.document_id == h.document.document_id for h in found)
    return spark.createDataFrame([(i + 1, round(h.relevance_score, 4)) for i, h in enumerate(found)], "rank_no long, score double")


@query(f"""WITH {_CHUNKS} SELECT content, md5 content_md5, count(*) n FROM chunks GROUP BY 1, 2""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The chunker of ingest, by lines only."""
    docs = _table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("name"), F.col("text").alias("content"),
        F.lit("").alias("source_id"), F.lit("{}").alias("metadata"), F.lit(0).alias("created_at"), F.lit(0).alias("updated_at"),
    )
    got = chunk.chunk_documents(docs, lines=_LINES, tokens=1 << 30)
    return got.groupBy("content", "content_md5").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str, like: DataFrame) -> DataFrame:
    """documents.parquet, a folder or one file, as a stream of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    reader = spark.readStream.schema(like.schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/documents.parquet")
    return reader.option("pathGlobFilter", "documents.parquet").parquet(d)


@query(f"""WITH {_CHUNKS} SELECT count(*) documents, count(*) points, true again_is_ignored FROM chunks""")
def stream_add(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files into a store; the same files again add nothing."""
    engine = _engine(spark)
    source = _table(spark, d, "documents")
    counts = []
    for _ in range(2):
        rows = _stream(spark, d, source)
        rows = rows.where(~text.is_blank(F.col("text"))).select(F.col("text").alias("content"), F.lit("").alias("name"))
        add_stream(engine, rows, _folder(spark), lines_per_chunk=_LINES, tokens_per_chunk=1 << 30).awaitTermination()
        counts.append((engine.db.documents.count(), engine.db.points.count()))
    return _row(spark, documents=counts[0][0], points=counts[0][1], again_is_ignored=counts[0] == counts[1])


# --- records, models, functions ----------------------------------------------------------


@query(f"""SELECT {_strip_sql("substring(split_part(title, chr(10), 1), 1, 28)")} AS name, md5({_strip_sql('title')}) content_md5, length(title)::INT content_length
FROM sources WHERE title IS NOT NULL AND {_strip_sql('title')} <> ''""")
def documents_from_contents(spark: SparkSession, d: str) -> DataFrame:
    titles = [r[0] for r in _table(spark, d, "sources").where(~text.is_blank(F.col("title"))).select("title").collect()]
    made = Document.from_contents(titles)
    return spark.createDataFrame(
        [(x.name, Document.hash_content(x.content), x.metadata["content_length"]) for x in made],
        "name string, content_md5 string, content_length int",
    )


@query(f"""SELECT md5({_strip_sql('title')}) content_md5, {_counts_sql('title')} embedding, true is_embedded
FROM sources WHERE title IS NOT NULL AND {_strip_sql('title')} <> ''""")
def points_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents to points, which get their vectors in one call of the model."""
    titles = [r[0] for r in _table(spark, d, "sources").where(~text.is_blank(F.col("title"))).select("title").collect()]
    made = Document.from_contents(titles)
    points = Point.set_embeddings([x.to_point() for x in made], [x.content for x in made], LetterCounts())
    return spark.createDataFrame(
        [(p.content_md5, p.to_python(), p.is_embedded) for p in points], "content_md5 string, embedding array<double>, is_embedded boolean",
    )


@query(f"SELECT document_id, {_counts_sql('content')} embedding FROM store_documents WHERE content IS NOT NULL")
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "store_documents").where("content is not null").select("document_id", "content")
    return embed.embed(docs, "content", LetterCounts()).select("document_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query("SELECT request_id, query_vector[1]::DOUBLE first_element, len(query_vector)::INT elements FROM search_requests WHERE len(query_vector) = 64")
def checked_vectors(spark: SparkSession, d: str) -> DataFrame:
    asks = _table(spark, d, "search_requests").where("size(query_vector) = 64")
    v = vectors.checked(F.col("query_vector"), 64)
    return asks.select("request_id", v[0].cast("double").alias("first_element"), F.size(v).alias("elements"))


@query("SELECT count(*) n, count(*) well_formed, count(*) in_time FROM store_documents")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Time-ordered ids of all documents."""
    made = _table(spark, d, "store_documents").select(
        ids.id_column("point", F.lit(1_700_000_000_000).cast("long")).alias("id"))
    shape = r"^pt-[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id").rlike(shape), 1)).alias("well_formed"),
        F.count(F.when(F.col("id").startswith("pt-018bcfe5-6800-"), 1)).alias("in_time"),
    )


@query("""SELECT document_id, CASE WHEN json_valid(metadata) AND json_type(CASE WHEN json_valid(metadata) THEN metadata END) = 'OBJECT'
  THEN metadata->>'$.lang' END lang FROM store_documents""")
def metadata_language(spark: SparkSession, d: str) -> DataFrame:
    """Of metadata that is made an object whatever it was."""
    return _table(spark, d, "store_documents").select(
        "document_id", F.get_json_object(text.json_object(F.col("metadata")), "$.lang").alias("lang"))


@query(f"""WITH {_DOCS}, {_PTS} SELECT p.point_id FROM pts p WHERE p.document_id = (SELECT min(document_id) FROM pts)
  AND p.content_md5 <> 'x' UNION ALL SELECT document_id FROM docs WHERE source_id = 'src-0003'""")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    """The predicates of removals and of filters, on tables."""
    db = _filled(spark, d)
    first = db.points.frame().agg(F.min("document_id")).first()[0]
    stale = db.points.frame().where(deletes.outdated(first, "x")).select("point_id")
    return stale.union(paging.filtered(db.documents.frame(), source_id="src-0003", content_md5=None).select("document_id"))
