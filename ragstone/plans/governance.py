"""Queries on integrity, leakage, hashing, components, folds and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragstone.functions.text import normalized_question, question_hash
from ragstone.operators import governance as V
from ragstone.operators import graph as N

from .fixtures import PREDICTIONS, predictions, table
from .registry import query
from .retrieval import documents

W = f"WITH {PREDICTIONS}"
NORM = r"trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))"


@query("""SELECT 'documents_unique' AS check_id, CAST(count(DISTINCT doc_id) AS VARCHAR) AS expected, CAST(count(*) AS VARCHAR) AS observed, CASE WHEN count(DISTINCT doc_id) = count(*) THEN 'pass' ELSE 'fail' END AS status, 'error' AS severity FROM documents
UNION ALL SELECT 'lengths', '0', CAST(count(*) FILTER (WHERE n_chars <> length(text)) AS VARCHAR), CASE WHEN count(*) FILTER (WHERE n_chars <> length(text)) = 0 THEN 'pass' ELSE 'fail' END, 'error' FROM documents
UNION ALL SELECT 'null_texts', '0', CAST(count(*) FILTER (WHERE text IS NULL) AS VARCHAR), CASE WHEN count(*) FILTER (WHERE text IS NULL) = 0 THEN 'pass' ELSE 'fail' END, 'error' FROM documents""")
def table_integrity_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.select("doc_id").distinct().count()
    return V.checks(docs, {
        "documents_unique": (F.count(F.lit(1)), n),
        "lengths": (F.count_if(F.col("n_chars") != F.length("text")), 0),
        "null_texts": (F.count_if(F.col("text").isNull()), 0),
    })


@query("""WITH d AS (SELECT sha256(text) AS h, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT h, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM d GROUP BY h HAVING count(DISTINCT split) > 1""")
def split_leakage_check(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "validation").otherwise("test")
    return V.leaking_keys(documents(spark, sf_dir).select(F.sha2("text", 256).alias("h"), split.alias("split")), "h")


@query("""SELECT 'first' AS side, CAST(count(*) AS BIGINT) AS keys FROM (SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
UNION ALL SELECT 'second', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id))""")
def referential_check(spark, sf_dir):
    return V.unmatched(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT c.c_custkey, CAST(coalesce(o.n, 0) AS BIGINT) AS matches FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def match_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return V.exactly_one(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("""SELECT source, CAST(count(DISTINCT lang) AS BIGINT) AS versions FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def duplicates_must_agree(spark, sf_dir):
    return V.conflicting(table(spark, sf_dir, "documents").select("source", "lang"), ["source"])


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE k = 1""")
def first_of_equal_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return V.first_per_key(docs, ["text"], ["doc_id"]).select("doc_id", "source")


@query("""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, 'first' AS side FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'second' FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)""")
def set_symmetric_difference(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id")
    return V.symmetric_difference(ids.filter("doc_id % 3 <> 0"), ids.filter("doc_id % 2 = 0"))


@query("""WITH l AS (SELECT sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS h FROM conversations),
p AS (SELECT CAST(count(*) AS BIGINT) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b, sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS c, sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS d FROM l)
SELECT n AS "rows", sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS sha256 FROM p""")
def semantic_table_hash(spark, sf_dir):
    return V.table_hash(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("""SELECT 'l_comment' AS feature, 0::BIGINT AS nulls, 0::BIGINT AS "rows" WHERE false UNION ALL
SELECT 'user_id', CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT), CAST(count(*) AS BIGINT) FROM events UNION ALL SELECT 'value', CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT), CAST(count(*) AS BIGINT) FROM events
UNION ALL SELECT 'props', CAST(count(*) FILTER (WHERE props IS NULL) AS BIGINT), CAST(count(*) AS BIGINT) FROM events""")
def feature_manifest(spark, sf_dir):
    return V.null_manifest(table(spark, sf_dir, "events").select("user_id", "value", "props"))


@query(f"""WITH n AS (SELECT doc_id, sha256({NORM}) AS h FROM documents) SELECT h AS normalized_sha256, CAST(count(*) AS BIGINT) AS documents, min(doc_id) AS first_doc_id FROM n GROUP BY h HAVING count(*) > 1""")
def normalized_duplicate_groups(spark, sf_dir):
    hashed = documents(spark, sf_dir).select("doc_id", question_hash(F.col("text")).alias("normalized_sha256"))
    return hashed.groupBy("normalized_sha256").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc_id")).filter("documents > 1")


@query(f"SELECT item_id, {NORM} AS normalized FROM benchmark")
def normalized_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", normalized_question(F.col("text")).alias("normalized"))


@query("""SELECT sha256('7|' || doc_id) AS sample_id, CAST(row_number() OVER (ORDER BY sha256('7|order|' || doc_id)) AS BIGINT) AS place, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY sha256('s|' || doc_id)) AS n FROM documents) WHERE n <= 5""")
def blinded_annotation_pack(spark, sf_dir):
    """Five documents of each source, in an order that says nothing of the source."""
    order = Window.partitionBy("source").orderBy(F.sha2(F.concat_ws("|", F.lit("s"), F.col("doc_id").cast("string")), 256))
    sample = table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(order)).filter("n <= 5").drop("n")
    return V.blinded_pack(sample, "doc_id", ["lang"], ["source"], "7")[0]


@query("""SELECT doc_id, sha256('3|' || doc_id) AS h FROM documents ORDER BY h LIMIT 100""")
def seeded_sample(spark, sf_dir):
    h = F.sha2(F.concat_ws("|", F.lit("3"), F.col("doc_id").cast("string")), 256)
    return documents(spark, sf_dir).select("doc_id", h.alias("h")).orderBy("h").limit(100)


@query()
def question_components(spark, sf_dir):
    """Orders connected by parts that they share, over all rows; recursive SQL is too slow for that, so tests hold it
    against union by rank."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("link"))
    return N.components(edges.select("node").distinct(), edges, "node")


@query(f"""{W}, s AS (SELECT source, count(*) AS n FROM predictions GROUP BY source), f AS (SELECT source, CAST((row_number() OVER (ORDER BY n DESC, source) - 1) % 5 AS INTEGER) AS fold FROM s)
SELECT fold, CAST(count(*) AS BIGINT) AS "rows", CAST(sum(y) AS BIGINT) AS positives, CAST(count(DISTINCT p.source) AS BIGINT) AS "groups", 0::BIGINT AS overlap FROM predictions p JOIN f ON f.source = p.source GROUP BY fold""")
def group_fold_manifest(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return N.fold_manifest(rows, N.group_folds(rows, "source", 5), "source", "y")


@query()
def grouped_split(spark, sf_dir):
    """70/15/15 by source, balanced in rows and positives: split, components and totals."""
    parts = predictions(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum("y").alias("positive"))
    split = N.split_components(parts, "source", ["total", "positive"], {"train": 0.7, "validation": 0.15, "test": 0.15}, "42")
    return parts.join(split, "source").groupBy("split").agg(F.count(F.lit(1)).alias("components"), F.sum("total").alias("total"), F.sum("positive").alias("positive"))


@query()
def balanced_annotation_sample(spark, sf_dir):
    """Ten documents of each language, spread over sources and strategies."""
    rows = predictions(spark, sf_dir).select("doc_id", "lang", "source", "strategy")
    return N.balanced_sample(rows, "lang", 10, ["strategy", "source"], "doc_id", "doc_id", "5")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN value IS NULL THEN 'unresolved' WHEN value < 10 THEN 'impossible' WHEN value < 40 THEN 'excluded' ELSE 'eligible' END AS role FROM events)
SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM e GROUP BY role""")
def exclusion_census(spark, sf_dir):
    v = F.col("value")
    role = F.when(v.isNull(), "unresolved").when(v < 10, "impossible").when(v < 40, "excluded").otherwise("eligible")
    return table(spark, sf_dir, "events").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT CAST(n AS BIGINT) AS turns, CAST(count(*) AS BIGINT) AS conversations FROM c GROUP BY n""")
def turns_per_conversation(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return per.groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"))


