"""Queries on chunks, evidence spans and sufficiency labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.text import cleaned_document, normalized_corpus_text, passages, reference_claims, segmented_claims
from ragstone.operators import alignment as A
from ragstone.operators.retrieval import DEPTHS

from .fixtures import table
from .registry import query
from .retrieval import BM25, bm25_hits, documents

SPANS = """, spans AS (SELECT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
PIECES = r"""pieces AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\s*\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS i FROM documents),
ends AS (SELECT doc_id, text, i, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(regexp_extract(p, '\S+')) AS n FROM pieces),
sizes AS (SELECT doc_id, max(i) AS size FROM ends GROUP BY doc_id),
starts AS (SELECT doc_id, size, unnest(range(0, CAST(greatest(0, ceil(CAST(size - 224 AS DOUBLE) / 176)) AS BIGINT) * 176 + 1, 176)) AS at FROM sizes),
chunks AS (SELECT s.doc_id, CAST(s.at // 176 AS INTEGER) AS chunk_index, CAST(a.e - a.n AS INTEGER) AS char_start, CAST(z.e AS INTEGER) AS char_end, a.text
  FROM starts s JOIN ends a ON a.doc_id = s.doc_id AND a.i = s.at + 1 JOIN ends z ON z.doc_id = s.doc_id AND z.i = least(s.at + 224, s.size))"""
CHUNK_HITS = """, chunk_hits AS (
  SELECT h.item_id, h.rank, c.doc_id, c.char_start AS cs, c.char_end AS ce FROM hits h JOIN chunks c ON c.doc_id = h.doc_id),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
prefix AS (SELECT item_id, k, doc_id, cs, ce FROM chunk_hits, ks WHERE rank <= k),
marked AS (SELECT *, CASE WHEN cs > coalesce(max(ce) OVER (PARTITION BY item_id, k, doc_id ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM prefix),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, k, doc_id ORDER BY cs, ce ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT item_id, k, doc_id, min(cs) AS cs, max(ce) AS ce FROM isl GROUP BY item_id, k, doc_id, island),
asked AS (SELECT * FROM spans, ks),
covered AS (SELECT a.item_id, a.k, a.doc_id, coalesce(sum(CASE WHEN m.cs IS NOT NULL THEN least(a.e, m.ce) - greatest(a.s, m.cs) END), 0)::DOUBLE / (a.e - a.s) AS coverage
  FROM asked a LEFT JOIN merged m ON m.item_id = a.item_id AND m.k = a.k AND m.doc_id = a.doc_id AND m.cs < a.e AND m.ce > a.s GROUP BY a.item_id, a.k, a.doc_id, a.s, a.e),
best AS (SELECT item_id, k, round(max(coverage), 6) AS coverage FROM covered GROUP BY item_id, k),
labels_ AS (SELECT b.item_id, k.k, NOT EXISTS (SELECT 1 FROM spans s WHERE s.item_id = b.item_id) AS impossible, coalesce(x.coverage, 0) AS coverage,
  EXISTS (SELECT 1 FROM hits h JOIN spans s ON s.item_id = h.item_id AND s.doc_id = h.doc_id WHERE h.item_id = b.item_id AND h.rank <= k.k) AS right_document
  FROM benchmark b CROSS JOIN ks k LEFT JOIN best x ON x.item_id = b.item_id AND x.k = k.k)"""


def spans(spark, sf_dir):
    return A.exact_spans(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def labelled(spark, sf_dir):
    """item_id, k, impossible, coverage, right_document for every benchmark item, from all chunks of the documents hit."""
    hits, found = bm25_hits(spark, sf_dir), spans(spark, sf_dir)
    chunks = A.offset_chunks(documents(spark, sf_dir).join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    placed = hits.join(chunks, "doc_id").select("item_id", "rank", "doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    wanted = found.select("item_id", "doc_id", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"))
    best = A.prefix_coverage(placed, wanted, "item_id", DEPTHS)
    ks = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k"))
    right = hits.join(found.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_semi").groupBy("item_id").agg(F.min("rank").alias("first"))
    known = found.select("item_id", F.lit(True).alias("known")).distinct()
    return (
        table(spark, sf_dir, "benchmark")
        .select("item_id")
        .crossJoin(F.broadcast(ks))
        .join(best, ["item_id", "k"], "left")
        .join(right, "item_id", "left")
        .join(known, "item_id", "left")
        .select(
            "item_id",
            "k",
            F.col("known").isNull().alias("impossible"),
            F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"),
            F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).alias("right_document"),
        )
    )


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?i)data:[a-z0-9.+/-]*;base64,[a-z0-9+/=]+', ' ', 'g'), '\s+', ' ', 'g')) AS t, text FROM documents)
SELECT doc_id, sha256(text) AS raw_sha256, sha256(t) AS normalized_sha256, CAST(length(t) AS BIGINT) AS n_chars FROM t""")
def corpus_manifest_hashes(spark, sf_dir):
    clean = normalized_corpus_text(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.sha2("text", 256).alias("raw_sha256"), F.sha2(clean, 256).alias("normalized_sha256"), F.length(clean).cast("long").alias("n_chars")
    )


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(text) <> ''),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 280)) AS pos FROM w)
SELECT doc_id, CAST(pos // 280 AS INTEGER) AS chunk_index, CAST(len(w[pos + 1 : pos + 360]) AS INTEGER) AS n_words, sha256(array_to_string(w[pos + 1 : pos + 360], ' ')) AS chunk_sha256
FROM s WHERE pos = 0 OR pos + 80 < len(w)""")
def word_window_chunks(spark, sf_dir):
    chunks = A.word_chunks(documents(spark, sf_dir), "doc_id")
    return chunks.select("doc_id", "chunk_index", "n_words", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(f"WITH {PIECES} SELECT doc_id, chunk_index, char_start, char_end, sha256(substr(text, char_start + 1, char_end - char_start)) AS chunk_sha256 FROM chunks")
def token_window_chunks(spark, sf_dir):
    return A.offset_chunks(documents(spark, sf_dir), "doc_id").withColumn("chunk_sha256", F.sha2("chunk", 256)).drop("chunk")


def bpe_offsets():
    """Where a public byte-pair tokenizer's tokens start and end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: loaded.encode(text, add_special_tokens=False).offsets


@query()
def model_token_chunks(spark, sf_dir):
    """Windows of 224 tokens of a public tokenizer, every 176."""
    return A.model_chunks(documents(spark, sf_dir), "doc_id", bpe_offsets).withColumn("chunk_sha256", F.sha2("chunk", 256)).drop("chunk")


@query(f"WITH {PIECES}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT CAST(n AS BIGINT) AS chunks, CAST(count(*) AS BIGINT) AS documents FROM n GROUP BY n")
def chunks_per_document(spark, sf_dir):
    per = A.offset_chunks(documents(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return per.groupBy("chunks").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH x AS (SELECT 1){SPANS} SELECT item_id, doc_id, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM spans")
def evidence_exact_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query(f"WITH x AS (SELECT 1){SPANS}, per AS (SELECT b.item_id, count(s.doc_id) AS n FROM benchmark b LEFT JOIN spans s ON s.item_id = b.item_id GROUP BY b.item_id)"
       " SELECT CAST(count(*) AS BIGINT) AS questions, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS aligned, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,"
       " CASE WHEN avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) >= 0.9 THEN 'pass' ELSE 'fail' END AS gate FROM per")  # fmt: skip
def alignment_feasibility(spark, sf_dir):
    found = spans(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    per = table(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left")
    aligned = F.count_if(F.col("n") > 0)
    return per.agg(F.count(F.lit(1)).alias("questions"), aligned.alias("aligned")).select(
        "questions", "aligned", F.round(F.col("aligned") / F.col("questions"), 6).alias("coverage"),
        F.when(F.col("aligned") / F.col("questions") >= 0.9, "pass").otherwise("fail").alias("gate"),
    )


@query()
def evidence_alignment(spark, sf_dir):
    """All places of the benchmark texts in the documents, exact or after normalization, and the texts without any."""
    return A.aligned_evidence(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"WITH {PIECES}, n AS (SELECT doc_id, char_end - char_start AS size FROM chunks) SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(min(size) AS INTEGER) AS minimum, round(avg(size), 6) AS mean, CAST(max(size) AS INTEGER) AS maximum FROM n")
def chunk_statistics(spark, sf_dir):
    size = F.col("char_end") - F.col("char_start")
    return A.offset_chunks(documents(spark, sf_dir), "doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"),
        F.min(size).alias("minimum"), F.round(F.avg(size), 6).alias("mean"), F.max(size).alias("maximum"),
    )


@query("""WITH w AS (SELECT l_orderkey, CAST(l_partkey % 500 AS BIGINT) AS s, CAST(l_partkey % 500 + l_quantity AS BIGINT) AS e FROM lineitem WHERE l_quantity > 0),
m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS f FROM w),
i AS (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT l_orderkey, min(s) AS "start", max(e) AS "end" FROM i GROUP BY l_orderkey, g""")
def interval_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % 500).cast("long").alias("start"),
        (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("long").alias("end"),
    )
    return A.merged_intervals(rows, "l_orderkey")


@query(f"WITH {BM25}{SPANS}, {PIECES}{CHUNK_HITS} SELECT item_id, CAST(k AS INTEGER) AS k, coverage FROM labels_ WHERE NOT impossible")
def span_interval_coverage(spark, sf_dir):
    return labelled(spark, sf_dir).filter("not impossible").select("item_id", "k", "coverage")


@query(f"""WITH {BM25}{SPANS}, {PIECES}{CHUNK_HITS} SELECT item_id, CAST(k AS INTEGER) AS k, CAST(CASE WHEN impossible THEN 0 WHEN coverage >= 1 THEN 1 ELSE 0 END AS INTEGER) AS y_suff,
CASE WHEN impossible THEN NULL ELSE coverage END AS coverage,
CASE WHEN impossible THEN 'benchmark_impossible' WHEN coverage >= 1 THEN 'automatic_positive' WHEN coverage > 0 THEN 'partial_overlap' WHEN right_document THEN 'correct_document_insufficient' ELSE 'wrong_document_retrieval' END AS stratum FROM labels_""")
def strict_sufficiency_labels(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    full = F.col("coverage") >= 1
    return rows.select(
        "item_id", "k",
        F.when(~F.col("impossible") & full, 1).otherwise(0).alias("y_suff"),
        F.when(~F.col("impossible"), F.col("coverage")).alias("coverage"),
        A.stratum(F.col("impossible"), full, F.col("coverage"), F.col("right_document")).alias("stratum"),
    )


@query(f"""WITH {BM25}{SPANS}, {PIECES}{CHUNK_HITS}, y AS (SELECT item_id, k, CASE WHEN NOT impossible AND coverage >= 1 THEN 1 ELSE 0 END AS y FROM labels_)
SELECT CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS conditions, CAST(sum(y) AS BIGINT) AS positive, round(avg(y), 6) AS share FROM y GROUP BY k""")
def development_summary(spark, sf_dir):
    y = F.when(~F.col("impossible") & (F.col("coverage") >= 1), 1).otherwise(0)
    return (
        labelled(spark, sf_dir)
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("conditions"), F.sum(y).alias("positive"), F.round(F.avg(y), 6).alias("share"))
    )


@query("""WITH y AS (SELECT user_id, event_id AS k, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y FROM events),
b AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY k) AS before FROM y) SELECT user_id, k, CAST(y AS INTEGER) AS y FROM b WHERE before > y""")
def label_monotonicity_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("k"), F.when(F.col("value") > 50, 1).otherwise(0).alias("y")
    )
    return A.monotonicity_violations(rows, ["user_id"], "k", "y")


CLAIMS = r"""lines AS (
  SELECT response_id, response, unnest(string_split(response, chr(10))) AS line, generate_subscripts(string_split(response, chr(10)), 1) AS ln FROM responses),
placed AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY response_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos0 FROM lines),
cut AS (SELECT *, string_split(regexp_replace(line, '([.!?])(\s+)([A-Z0-9(<\[])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS parts FROM placed),
part AS (SELECT response_id, response, ln, pos0, unnest(parts) AS p, generate_subscripts(parts, 1) AS pn FROM cut),
off AS (SELECT *, pos0 + CAST(coalesce(sum(length(p)) OVER (PARTITION BY response_id, ln ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM part),
lead_ AS (SELECT *, greatest(length(regexp_extract(p, '^\s*(?:[-*•]+|\(?\d+[.)]|[A-Za-z][.)])\s+')), length(regexp_extract(p, '^\s+'))) AS l FROM off),
body AS (SELECT *, regexp_replace(substr(p, l + 1), '\s+$', '') AS t FROM lead_),
claims AS (SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY ln, pn) AS INTEGER) AS claim_index, CAST(o + l AS INTEGER) AS s, CAST(o + l + length(t) AS INTEGER) AS e, t
  FROM body WHERE regexp_matches(t, '[\p{L}\p{N}]'))"""


def claims(spark, sf_dir):
    from .fixtures import responses

    return (
        responses(spark, sf_dir)
        .withColumn("c", F.explode(segmented_claims(F.col("response"))))
        .select("response_id", "question", "response", "c.*")
    )


@query()
def input_files(spark, sf_dir):
    """The files that the tables are read from, each with its hash."""
    from ragstone.sources.readers import read_folder

    return read_folder(spark, sf_dir).select("path", F.length("content").cast("long").alias("bytes"), "sha256")


@query("""SELECT p.page_id, sha256(p.url) AS url_sha256, CAST(length(p.html) AS BIGINT) AS n_chars FROM pages p""")
def page_manifest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("url_sha256"), F.length("html").cast("long").alias("n_chars"))


@query()
def page_text(spark, sf_dir):
    """Pages without markup and with all HTML entities resolved, for which SQL has no function."""
    from ragstone.functions.text import collapsed, without_markup

    return table(spark, sf_dir, "pages").select("page_id", F.sha2(collapsed(without_markup(F.col("html"))), 256).alias("text_sha256"))


@query()
def reference_claim_rows(spark, sf_dir):
    """Claims of benchmark texts, semicolons and markup included; the finite-verb rule needs look-around."""
    claims_ = reference_claims(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(claims_).alias("claim_index", "claim"))


@query()
def passage_rows(spark, sf_dir):
    """Each benchmark text, whole, as two passages: its first half and the rest."""
    size = F.length("text")
    half = F.ceil(size / 2).cast("int")
    made = F.concat(
        F.lit("passage 1:"), F.substring("text", F.lit(1), half), F.lit("\npassage 2:"), F.substring("text", half + 1, size)
    )
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(passages(made)).alias("p")).select("item_id", "p.number", "p.text")


@query()
def cleaned_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(cleaned_document(F.col("text")), 256).alias("clean_sha256"))


