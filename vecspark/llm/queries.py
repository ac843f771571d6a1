"""The llm queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import budget, clusters, forms, knn, link, near, packing, pii, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found_clusters(_table(spark, d, "points"))


def p1_described(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(_table(spark, d, "points"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of texts that bring no vectors, by hashed weighted features."""
    features = clusters.hashed_vectors(_table(spark, d, "store_documents"), "document_id", "content")
    got = clusters.cluster(features, "id", [], "embedding")
    return got.groupBy("cluster_id", "size").agg(F.round(F.avg("cosine"), 3).alias("mean_cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near.found_pairs(_table(spark, d, "store_documents"), threshold=0.6)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_table(spark, d, "store_documents"), threshold=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return link.found_links(_table(spark, d, "incoming_batches"), _table(spark, d, "store_documents"))


def p3_representatives(spark: SparkSession, d: str) -> DataFrame:
    return link.representatives(_table(spark, d, "incoming_batches"), _table(spark, d, "store_documents"))


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(_table(spark, d, "store_documents"), _table(spark, d, "sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.found_copies(_table(spark, d, "store_documents"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return forms.collapsed(_table(spark, d, "store_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.found_pairs(_table(spark, d, "points"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbours(_table(spark, d, "points")).withColumnRenamed("id", "point_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_table(spark, d, "documents"), _table(spark, d, "members"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(_table(spark, d, "documents"), _table(spark, d, "members"))


QUERIES = {f.__name__: f for f in (p1_found, p1_described, p1_texts, p2_found, p2_groups, p3_found, p3_representatives, p5_budget, p6_found, p6_collapsed, p7_found, p7_neighbours, p8_ids, p9_packed, p10_found, p10_masked)}

# The SQL goes over whole tables too; where that is too slow (or SQL cannot
# say it: p1, p5, p8, p9, p10, the approximate p7_neighbours), tests compare
# with brute force, round trips or the tokenizer instead.

_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"
_LETTERS = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_WS = r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FORMS = f"""WITH l AS (SELECT document_id, content, list_filter(regexp_split_to_array(lower(content), '\\r\\n|\\n|\\r'),
    lambda x: regexp_matches(x, '[^{_WS}]')) lines FROM store_documents WHERE content IS NOT NULL),
f AS (SELECT document_id, {_LETTERS.format(c='content')} letters,
  CASE WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^[{_WS}]*[\\p{{L}}\\p{{N}}]+[{_WS}]*:.*[\\p{{L}}\\p{{N}}]'))) = 0
  THEN array_to_string(list_sort(list_transform(lines, lambda x: {_LETTERS.format(c='x')})), chr(10)) END card FROM l)"""

_SAME = """CASE WHEN {a}.card IS NOT NULL AND {b}.card IS NOT NULL THEN {a}.card = {b}.card ELSE {a}.letters = {b}.letters END"""

# every text is a class of copies (c), with its words, letters and card
_CLASSES = f"""{_FORMS}, x AS (SELECT f.document_id, letters, card, {_WORDS} w FROM f JOIN store_documents USING (document_id)),
cls AS (SELECT document_id, letters, card, w, dense_rank() OVER (ORDER BY w, card) c FROM x),
one AS (SELECT c, any_value(letters) letters, any_value(card) card, any_value(w) w, min(document_id) first_id FROM cls GROUP BY c),
s AS (SELECT DISTINCT c, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT c, w, unnest(range(1, len(w) - 1)) i FROM one)),
n AS (SELECT c, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.c x, b.c y, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2),
half AS (SELECT x, y FROM p JOIN n na ON na.c = x JOIN n nb ON nb.c = y JOIN one fa ON fa.c = x JOIN one fb ON fb.c = y
  WHERE k * 5 >= 3 * (na.n + nb.n - k) AND NOT {_SAME.format(a='fa', b='fb')}),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half)"""

# arrivals in their order (i) and accepted records; a record of the store that
# an arrival pairs with refuses it, and so does an accepted arrival before it
_ARRIVALS = f"""WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY batch_no, seq_no) i, document_id, content FROM incoming_batches
  WHERE content IS NOT NULL AND regexp_matches(content, '[^{_WS}]')),
every AS (SELECT i, document_id, content FROM a UNION ALL
  SELECT NULL, document_id, content FROM store_documents WHERE content IS NOT NULL AND regexp_matches(content, '[^{_WS}]')),
l AS (SELECT document_id, i, content, list_filter(regexp_split_to_array(lower(content), '\\r\\n|\\n|\\r'),
    lambda x: regexp_matches(x, '[^{_WS}]')) lines FROM every),
f AS (SELECT document_id, i, {_LETTERS.format(c='content')} letters, {_WORDS} w,
  CASE WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^[{_WS}]*[\\p{{L}}\\p{{N}}]+[{_WS}]*:.*[\\p{{L}}\\p{{N}}]'))) = 0
  THEN array_to_string(list_sort(list_transform(lines, lambda x: {_LETTERS.format(c='x')})), chr(10)) END card FROM l),
s AS (SELECT DISTINCT document_id, i, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] g FROM (SELECT document_id, i, w, unnest(range(1, len(w) - 1)) j FROM f)),
n AS (SELECT document_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.document_id x, b.document_id y, count(*) k FROM s a JOIN s b ON a.g = b.g
  WHERE a.i IS NOT NULL AND (b.i IS NULL OR b.i < a.i) GROUP BY 1, 2),
pairs AS (SELECT x, y FROM p JOIN n na ON na.document_id = x JOIN n nb ON nb.document_id = y WHERE k * 5 >= 3 * (na.n + nb.n - k)
  UNION SELECT fa.document_id, fb.document_id FROM f fa JOIN f fb ON fa.card = fb.card
    WHERE fa.i IS NOT NULL AND (fb.i IS NULL OR fb.i < fa.i)
  UNION SELECT fa.document_id, fb.document_id FROM f fa JOIN f fb ON fa.letters = fb.letters
    WHERE fa.i IS NOT NULL AND (fb.i IS NULL OR fb.i < fa.i) AND (fa.card IS NULL OR fb.card IS NULL)),
r AS (SELECT a.i, coalesce(bool_or(b.document_id IS NULL AND q.y IS NOT NULL), false) stored,
    coalesce(list(b.i) FILTER (WHERE b.i IS NOT NULL), []) earlier
  FROM a LEFT JOIN pairs q ON q.x = a.document_id LEFT JOIN a b ON b.document_id = q.y GROUP BY 1),
walk AS (SELECT 0::BIGINT i, []::BIGINT[] accepted UNION ALL
  SELECT r.i, CASE WHEN r.stored OR list_has_any(r.earlier, accepted) THEN accepted ELSE list_append(accepted, r.i) END
  FROM walk JOIN r ON r.i = walk.i + 1),
taken AS (SELECT unnest(accepted) i FROM (SELECT accepted FROM walk ORDER BY i DESC LIMIT 1)),
records AS (SELECT document_id FROM every WHERE i IS NULL UNION ALL SELECT document_id FROM a JOIN taken USING (i))"""

ORACLE: dict[str, str] = {
    "p6_collapsed": f"""{_FORMS} SELECT min(document_id) document_id, count(*) n_copies FROM f GROUP BY coalesce('c' || card, 'l' || letters)""",
    "p2_groups": f"""{_CLASSES.replace('WITH l AS', 'WITH RECURSIVE l AS', 1)},
reach AS (SELECT x, x m FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.m),
named AS (SELECT r.x c, min(first_id) group_id FROM reach r JOIN one ON one.c = r.m GROUP BY 1)
SELECT document_id id, group_id, n_links FROM cls JOIN named USING (c) JOIN (SELECT x c, count(*) n_links FROM links GROUP BY 1) USING (c)""",
    "p3_found": f"""{_ARRIVALS} SELECT least(x, y) document_id_a, greatest(x, y) document_id_b FROM pairs JOIN records ON y = document_id""",
    "p6_found": f"""{_FORMS}, g AS (SELECT coalesce('c' || card, 'l' || letters) form, min(document_id) document_id, count(*) n FROM f GROUP BY 1)
SELECT g.document_id, f.document_id copy_document_id FROM f JOIN g ON coalesce('c' || card, 'l' || letters) = form
WHERE f.document_id <> g.document_id""",
    "p2_found": f"""{_FORMS}, w AS (SELECT document_id, {_WORDS} w FROM store_documents WHERE content IS NOT NULL),
s AS (SELECT DISTINCT document_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT document_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
n AS (SELECT document_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.document_id x, b.document_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.document_id < b.document_id GROUP BY 1, 2)
SELECT x document_id_a, y document_id_b FROM p JOIN n na ON na.document_id = x JOIN n nb ON nb.document_id = y
JOIN f fa ON fa.document_id = x JOIN f fb ON fb.document_id = y
WHERE c * 5 >= 3 * (na.n + nb.n - c)
  AND NOT CASE WHEN fa.card IS NOT NULL AND fb.card IS NOT NULL THEN fa.card = fb.card ELSE fa.letters = fb.letters END""",
    "p7_found": """WITH u AS (SELECT DISTINCT point_id, embedding::DOUBLE[] e FROM points WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.point_id x, b.point_id y, list_cosine_similarity(a.e, b.e) c FROM u a JOIN u b ON a.point_id <> b.point_id),
t AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 6) DESC, y) r FROM s)
SELECT DISTINCT least(x, y) point_id_a, greatest(x, y) point_id_b FROM t WHERE r <= 5 AND c >= 0.95""",
}
