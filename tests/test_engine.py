import asyncio

import numpy as np
import pytest

from vecspark import Document, Engine, Manifest, Point, SearchRequest, SearchResult
from vecspark.embed import HashingEmbedder, embed_cached
from vecspark.errors import BadRequestError, NotFoundError
from vecspark.functions.vectors import encode_base64
from vecspark.models import ensure_dict
from vecspark.sources import files
from vecspark.sources.store import Conflict, Store
from vecspark.streaming.ingest import add_stream
from vecspark.tables import Database

D = 16


def vector(seed):
    return [float(x) for x in np.random.RandomState(seed).uniform(-1, 1, D).astype(np.float32)]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(str(tmp_path / "store"), HashingEmbedder(D), spark=spark)


@pytest.fixture
def db(spark, tmp_path):
    d = Database(Store(spark, str(tmp_path / "db")))
    d.touch()
    return d


def test_add_search_remove(engine):
    first = engine.add(["cats and dogs", "the weather today", "cats and dogs"])
    assert first == {"success": True, "created_documents": 3, "ignored_documents": 0, "created_points": 3, "error": None}
    assert engine.add(["cats and dogs 　", "\x1fthe weather today"])["ignored_documents"] == 2
    hits = engine.search("cats and dogs", 2)
    assert len(hits) == 2 and abs(hits[0][2] - 1) < 1e-5 and hits[0][0].embedding is None and not hits[0][0].is_embedded
    assert hits[0][0].document_id == hits[0][1].document_id
    full = asyncio.run(engine.asearch("weather", 1, with_embedding=True))
    assert len(full[0][0].to_python()) == D
    assert SearchResult.from_search_result(full[0]).document.content == "the weather today"
    engine.remove(hits[0][1].document_id)
    engine.remove([])
    engine.remove("doc-missing")
    assert engine.db.documents.count() == engine.db.points.count() == 2
    assert engine.search("x", 0) == []
    with pytest.raises(ValueError):
        engine.search("x", -1)
    with pytest.raises(ValueError):
        engine.search("  ")


def test_add_options(engine):
    text = "\n".join(f"line {i}" for i in range(45))
    got = engine.add(Document.from_content(text, name="big", metadata={"a": 1}), link_parent=True)
    assert got["created_documents"] == 3
    page = engine.db.documents.list()
    assert {d.chunk_index for d in page.data} == {0, 1, 2} and all(d.is_chunk and d.source_id and d.metadata == {"a": 1} for d in page.data)
    assert engine.add([text], ignore_same_content=False)["created_documents"] == 3
    assert engine.add(["same", "same"], dedupe_within_batch=True)["created_documents"] == 1


def test_failing_model_leaves_nothing(spark, tmp_path):
    class Failing(HashingEmbedder):
        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return super().embed(texts)

    e = Engine(str(tmp_path / "s"), Failing(D), spark=spark)
    with pytest.raises(Exception):
        e.add(["good", "bad"], batch_size=1)
    assert e.db.documents.count() == e.db.points.count() == 0
    assert e.add(["good"])["created_documents"] == 1


def test_manifest_is_reconciled(spark, tmp_path):
    at = str(tmp_path / "s")
    Engine(at, HashingEmbedder(D), spark=spark)
    with pytest.raises(ValueError):
        Engine(at, HashingEmbedder(D, name="other"), spark=spark)
    with pytest.raises(ValueError):
        Engine(at, HashingEmbedder(D + 1), spark=spark)
    open_model = HashingEmbedder(0)
    assert Engine(at, open_model, spark=spark).manifest.embedding_dimensions == D == open_model.dimensions
    with pytest.raises(ValueError):
        Engine(str(tmp_path / "t"), HashingEmbedder(0), spark=spark)
    with pytest.raises(ValueError):
        Engine("", HashingEmbedder(D), spark=spark)


def test_documents(db):
    docs = db.documents
    assert docs.touch() is False and db.show_table_names() == ("documents", "manifest", "points")
    one = docs.create(Document.from_content("hello", name="n", metadata={"author": "x"}))
    two = docs.create({"name": "d", "content": "dict", "content_md5": "wrong", "metadata": None, "unknown": 1})
    assert two.content_md5 == Document.hash_content("dict")
    assert docs.retrieve(one.document_id).metadata == {"author": "x"}
    with pytest.raises(NotFoundError):
        docs.retrieve("doc-none")
    assert docs.bulk_create([]) == [] and docs.retrieve_many([]) == []
    assert [d.content for d in docs.retrieve_many([one.document_id, "none", one.document_id])] == ["hello"]
    docs.bulk_create([Document(content=f"t{i}", source_id="s") for i in range(4)])
    with pytest.raises(ValueError):
        docs.create(one)  # the key exists
    with pytest.raises(ValueError):
        docs.bulk_create([Document(content="a", document_id="k"), Document(content="b", document_id="k")])
    page = docs.list(limit=3)
    rest = docs.list(limit=3, after=page.last_id)
    assert page.has_more and not rest.has_more and len(rest.data) == 3
    assert {d.document_id for d in page.data}.isdisjoint(d.document_id for d in rest.data)
    assert docs.list(source_id="s", order="desc", limit=2).has_more
    up = [d.document_id for d in docs.gen(limit=2)]
    assert up == sorted(up) and len(up) == 6
    assert [d.document_id for d in docs.gen(limit=2, order="desc")] == up[::-1]
    assert [d.document_id for d in docs.gen(limit=2, after=up[2])] == up[3:]
    assert docs.count() == 6 and docs.count(document_id=up[0]) == 1 and docs.count(content_md5="none") == 0
    assert docs.content_exists(one.content_md5) and not docs.content_exists("none")
    docs.remove(one.document_id)
    docs.remove("doc-none")
    assert docs.count() == 5
    with pytest.raises(ValueError):
        docs.drop()
    docs.drop(force=True)
    assert docs.count() == 0 and "documents" in db.show_table_names()
    docs.drop(force=True, touch_after_drop=False)
    assert "documents" not in db.show_table_names()


def test_points(db):
    pts = db.points
    with pytest.raises(ValueError):
        pts.create(Point("d", "m"))
    made = pts.bulk_create([Point(f"d{i % 2}", f"m{i}", embedding=vector(i)) for i in range(5)])
    assert pts.retrieve(made[0].point_id).embedding is None
    assert pts.retrieve(made[0].point_id, with_embedding=True).to_python() == vector(0)
    assert pts.list(document_id="d0").data[0].document_id == "d0" and pts.count(document_id="d1") == 2
    assert len(list(pts.gen(limit=2))) == 5 and len(list(pts.gen(limit=2, after=sorted(p.point_id for p in made)[3]))) == 1
    pts.remove_outdated(document_id="d1", content_md5="m1")
    assert pts.count(document_id="d1") == 1
    pts.remove_many([])
    pts.remove_many([], document_ids=["d1"])
    pts.remove_many([made[0].point_id], content_md5s=["m2"])
    assert [p.content_md5 for p in pts.gen()] == ["m4"] and pts.content_exists("m4")
    pts.create({"point_id": made[0].point_id, "document_id": "d", "content_md5": "again", "embedding": encode_base64(vector(1))})
    assert pts.count() == 2  # a removed key may come back
    db.store.compact("points")
    assert pts.count() == 2
    pts.remove(made[0].point_id)
    assert pts.count() == 1


def with_metadata(db, texts):
    """A document and a point for each metadata text, stored as it is."""
    rows = [(f"k{i}", t) for i, t in enumerate(texts)]
    frame = db.store.spark.createDataFrame(rows, "document_id string, metadata string")
    db.store.commit(append={
        "documents": frame.selectExpr(
            "document_id", "'n' AS name", "'text' AS content", "md5('text') AS content_md5", "'s' AS source_id", "0 AS chunk_index",
            "false AS is_chunk", "1 AS total_tokens", "metadata", "0 AS created_at", "0 AS updated_at"),
        "points": frame.selectExpr("document_id AS point_id", "document_id", "'m' AS content_md5", "array(1.0, 2.0) AS embedding", "metadata"),
    })


ODD_METADATA = ['{"lang": ', '{"lang": "en"}', "[1]", "3", "", None, "nul", "[" * 100_000]
ODD_DICTS = [{}, {"lang": "en"}, {}, {}, {}, {}, {}, {}]


def test_retrieve_with_broken_metadata(db):
    with_metadata(db, ODD_METADATA)
    assert [x.metadata for x in db.documents.retrieve_many([f"k{i}" for i in range(9)])] == ODD_DICTS
    assert db.documents.retrieve("k0").metadata == db.points.retrieve("k0").metadata == {}
    assert db.documents.frame().where("document_id = 'k0'").first()["metadata"] == '{"lang": '  # the row keeps its text
    with pytest.raises(ValueError):
        Document("x", metadata='{"lang": ')  # new records are still checked


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_with_broken_metadata(db, order):
    with_metadata(db, ODD_METADATA)
    step = 1 if order == "asc" else -1
    for table in (db.documents, db.points):
        assert [x.metadata for x in table.gen(limit=3, order=order)] == ODD_DICTS[::step]
        assert [x.metadata for x in table.list(limit=3, order=order).data] == ODD_DICTS[::step][:3]


def test_retrieve_many_ids(db, monkeypatch):
    with_metadata(db, ["{}"] * 5)
    monkeypatch.setattr("vecspark.tables.LISTED_IDS", 2)
    got = db.documents.retrieve_many(["k3", "none", "k0", "k3", None, "k1"])
    assert [x.document_id for x in got] == ["k0", "k1", "k3"] and got[0].content == "text" and got[0].source_id == "s"


def test_manifest(db):
    assert db.manifest.receive() is None
    assert db.manifest.create({"embedding_model": "m", "embedding_dimensions": 1536}).points_table_name == "points"
    assert db.manifest.receive().embedding_dimensions == 1536
    with pytest.raises(ValueError):
        db.manifest.create(Manifest("m2", 3))
    db.manifest.drop()
    assert db.manifest.receive() is None


def test_commits_conflict(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit(create=("documents",))
    number, tables = s.state()
    s.commit(create=("points",))
    with pytest.raises(Conflict):
        s._publish(number + 1, tables)


def test_models():
    with pytest.raises(ValueError):
        Document(content=" \n")
    with pytest.raises(ValueError, match=r"contents\[1\]"):
        Document.from_contents(["a", "  "])
    with pytest.raises(TypeError):
        Document.from_contents([3])
    d = Document.from_contents("first line is long enough to cut\nsecond")[0]
    assert d.name == "first line is long enough to" and d.metadata["content_length"] == 39
    assert d.to_point().content_md5 == d.content_md5 and d.sanitize(refresh=True, count_tokens=len).total_tokens == 39
    assert Point("d", "m", embedding=[]).is_embedded is False
    with pytest.raises(ValueError):
        Point("d", "m").to_python()
    with pytest.raises(ValueError):
        Point.set_embeddings([Point("d", "m")], [], HashingEmbedder(D))
    assert Point.set_embeddings([Point("d", "m")], ["t"], HashingEmbedder(D))[0].is_embedded
    assert ensure_dict('{"a": 1}') == {"a": 1} and ensure_dict("") == {} and ensure_dict({"d": 1}) == {"d": 1}


def test_requests_to_vectors():
    m = HashingEmbedder(D)
    got = SearchRequest.to_vectors(
        [SearchRequest("text"), SearchRequest(encode_base64(vector(1))), SearchRequest(vector(2), encoding="plaintext"),
         SearchRequest("internationalize"), SearchRequest(encode_base64(vector(3)), encoding="base64")], m)
    assert got[1] == vector(1) and got[2] == vector(2) and got[4] == vector(3)
    assert np.allclose(got[3], m.embed(["internationalize"])[0])
    for bad in (SearchRequest(""), SearchRequest([]), SearchRequest("x", encoding="vector"), SearchRequest([1.0])):
        with pytest.raises(BadRequestError):
            SearchRequest.to_vectors(bad, m)


def test_cache_embeds_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "one"), ("b", "two"), ("a", "one")], "content_md5 string, content string")
    at = str(tmp_path / "cache")
    m = HashingEmbedder(D)
    assert embed_cached(df, "content", "content_md5", m, at).count() == 3

    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("must not be called")

    again = embed_cached(df, "content", "content_md5", Broken(D), at).collect()
    assert len(again) == 3 and np.allclose(again[0]["embedding"], m.embed([again[0]["content"]])[0])


def test_files_and_stream(spark, tmp_path, engine):
    folder = tmp_path / "texts" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("  alpha text \n")
    (folder / "b.txt").write_text("beta text")
    got = {r["name"]: r for r in files.text_documents(spark, str(tmp_path / "texts")).collect()}
    assert got["a.txt"]["content"] == "alpha text" and '"content_length":10' in got["a.txt"]["metadata"]
    with pytest.raises(ValueError):
        files.download_dataset("nope", str(tmp_path))
    rows = spark.createDataFrame([("n1", "streamed one"), ("n2", "streamed two")], "name string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = add_stream(engine, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
        q.awaitTermination()
        assert engine.db.documents.count() == 2
    assert engine.search_many(spark.createDataFrame([(1, engine.model.embed(["streamed two"])[0].tolist(), 1)], "request_id long, query_vector array<float>, top_k int")).count() == 1


def test_unsafe_archive(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        files.unpack(str(tmp_path / "x.zip"), str(tmp_path / "out"))


def test_bloom_filters_change_no_result(spark, tmp_path):
    d = Database(Store(spark, str(tmp_path / "b"), bloom_filters=True))
    d.touch()
    made = d.documents.bulk_create([Document(content=f"text {i}") for i in range(50)])
    assert d.documents.retrieve(made[7].document_id).content == "text 7" and d.documents.content_exists(made[3].content_md5)
    d.store.compact("documents")
    assert d.documents.count() == 50
