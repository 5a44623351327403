"""The queries of this subpackage over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import format_copies, lookalike, mixing, near_duplicates, nearest_vectors, pair_defects, tokenize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.broken_pairs(table(spark, folder, "faq"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors.neighbour_pairs(nearest_vectors.nearest_neighbours(table(spark, folder, "document_vectors")))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors.nearest_neighbours(table(spark, folder, "document_vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, folder, "documents"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, folder, "documents"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, content) of articles and documents."""
    articles = table(spark, folder, "articles").select(F.lit("articles").alias("tbl"), "id", "content")
    documents = table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "content")
    return articles.unionByName(documents)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies.copies(contents(spark, folder))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies.copy_groups(contents(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p7_balance(spark: SparkSession, folder: str) -> DataFrame:
    """(source, within, capped): whether each source misses what it may give by less than one document, and keeps its cap."""
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    chosen, shares = mixing.mix_sources(docs, targets)
    texts = docs.where(F.length("text") > 0).join(targets.select("source"), "source", "left_semi")
    sizes = tokenize.count_tokens(texts, ["source"]).groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("longest"))
    used = chosen.groupBy("source").agg(F.max("uses").alias("uses"))
    rows = shares.join(targets.select("source", "max_repeats"), "source").join(sizes, "source", "left").join(used, "source", "left")
    able = F.least("target_tokens", F.col("max_repeats") * F.coalesce("have", F.lit(0)))
    within = F.abs(F.col("actual_tokens") - able) <= F.coalesce("longest", F.lit(0))
    return rows.select("source", within.cast("int").alias("within"), (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).cast("int").alias("capped"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, folder, "documents"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, folder, "documents")).select("doc_id", "canonical")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_alike_classes_of(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (p1_found, p3_found, p3_neighbours, p4_found, p4_groups, p5_found, p5_groups, p6_ids, p7_mix, p7_shares, p7_balance, p8_found, p8_canonical, p8_classes)
}
# Brute force in SQL: all sets of substrings joined with each other.
SIMILAR = """
WITH n AS (SELECT doc_id, regexp_replace(lower(content), '[^\\p{L}\\p{M}\\p{Nd}]+', '', 'g') AS t FROM documents WHERE content IS NOT NULL),
g AS (SELECT DISTINCT doc_id, substr(t, i, 8) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 6)) AS i FROM n WHERE length(t) >= 8)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE shared >= 0.7 * (sx.n + sy.n - shared)
"""
# DuckDB writes no final sigma, so both of its forms count as one here; no two of the texts differ by it alone.
COPIES = """
WITH r AS (SELECT 'articles' AS tbl, id, content FROM articles UNION ALL SELECT 'documents', doc_id, content FROM documents),
c AS (SELECT * FROM r WHERE regexp_matches(content, '[\\p{L}\\p{M}\\p{Nd}]')),
j AS (SELECT *, CASE WHEN content LIKE '%{%' AND json_valid(content) AND json_type(content) = 'OBJECT' THEN content::JSON END AS o FROM c),
k AS (SELECT *, list_filter(regexp_split_to_array(content, '\\r\\n|\\r|\\n'), lambda l: regexp_matches(l, '[^\\s\\p{Z}]')) AS lines FROM j),
f AS (SELECT tbl, id, content, CASE
    WHEN o IS NOT NULL AND len(list_filter(json_keys(o), lambda n: json_type(o, '$."' || n || '"') <> 'VARCHAR')) = 0
    THEN list_transform(json_keys(o), lambda n: [n, json_extract_string(o, '$."' || n || '"')])
    WHEN len(list_filter(lines, lambda l: NOT regexp_matches(l, '^[^:\\p{L}\\p{M}\\p{Nd}]*[\\p{L}\\p{M}\\p{Nd}]+[^:\\p{L}\\p{M}\\p{Nd}]*:'))) = 0
    THEN list_transform(lines, lambda l: [split_part(l, ':', 1), substr(l, instr(l, ':') + 1)])
    ELSE [[chr(1) || 'prose', content]] END AS fields FROM k),
w AS (SELECT tbl, id, list_sort(list_transform(fields, lambda p: list_transform(p, lambda x:
    CASE WHEN x = chr(1) || 'prose' THEN x ELSE trim(regexp_replace(replace(lower(x), 'ς', 'σ'), '[^\\p{L}\\p{M}\\p{Nd}]+', ' ', 'g')) END))) AS key FROM f),
m AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, key) AS kept_id FROM w)
SELECT tbl, kept_id, id AS copy_id FROM m WHERE id <> kept_id
"""
COPY_GROUPS = COPIES[: COPIES.index("m AS (SELECT tbl, id, min(id)")].rstrip().rstrip(",") + """
SELECT tbl, min(id) AS kept_id, count(*) AS n_rows FROM w GROUP BY tbl, key
"""
# Groups by the closure of all similar pairs; links between contents, copies of one content aside.
SIMILAR_GROUPS = SIMILAR.replace("WITH n AS", "WITH RECURSIVE n AS").replace("SELECT x AS doc_id_a, y AS doc_id_b FROM", ", f AS (SELECT x, y FROM", 1).rstrip() + """),
e AS (SELECT x, y FROM f UNION SELECT y, x FROM f),
m AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS rep, count(*) OVER (PARTITION BY t) AS copies FROM n WHERE length(t) >= 8),
r AS (SELECT doc_id AS x, doc_id AS y FROM m UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS group_id FROM r GROUP BY x),
l AS (SELECT a.doc_id, count(DISTINCT b.rep) FILTER (b.rep <> a.rep) AS links FROM e JOIN m a ON a.doc_id = e.x JOIN m b ON b.doc_id = e.y GROUP BY 1)
SELECT m.doc_id, c.group_id, coalesce(l.links, 0) + m.copies - 1 AS n_links FROM m JOIN c ON c.x = m.doc_id LEFT JOIN l ON l.doc_id = m.doc_id
"""
# Brute force: all pairs of usable vectors.
NEIGHBOURS = """
WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM document_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id),
n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE r <= 5
"""
BALANCE = "SELECT source, 1::INT AS within, 1::INT AS capped FROM mix_targets WHERE source IS NOT NULL"
SQL: dict[str, str] = {"p3_found": NEIGHBOURS, "p4_found": SIMILAR, "p4_groups": SIMILAR_GROUPS, "p5_found": COPIES, "p5_groups": COPY_GROUPS, "p7_balance": BALANCE}
