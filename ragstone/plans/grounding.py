"""Queries on claims and grounding: assistant turns are responses, earlier turns their context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.text import judge_score, rouge_l_f1, sentences
from ragstone.functions.vectors import rounded_as_sql
from ragstone.operators import grounding as G
from ragstone.operators.alignment import overlapping

from .alignment import CLAIMS, claims
from .fixtures import RESPONSES, responses, table
from .metrics import rounded
from .registry import query

W = f"WITH {RESPONSES}, {CLAIMS}"
WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
PAIRS = f"""{W}, ctx AS (SELECT conv_id, turn, conv_id || ':' || turn AS chunk_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rank, {WORDS.format('text')} AS s FROM conversations),
cw AS (SELECT c.response_id, c.claim_index, r.conv_id, r.turn, {WORDS.format('c.t')} AS s FROM claims c JOIN responses r USING (response_id)),
pr AS (SELECT c.response_id, c.claim_index, x.chunk_id, x.rank, len(list_intersect(c.s, x.s)) AS i, len(c.s) AS a, len(x.s) AS b FROM cw c JOIN ctx x ON x.conv_id = c.conv_id AND x.turn < c.turn),
sim AS (SELECT response_id, claim_index, chunk_id, rank, CASE WHEN a + b - i > 0 THEN round(i::DOUBLE / (a + b - i), 6) ELSE 0 END AS similarity, CASE WHEN a > 0 THEN round(i::DOUBLE / a, 6) ELSE 0 END AS entailment FROM pr),
top AS (SELECT *, row_number() OVER (PARTITION BY response_id, claim_index ORDER BY similarity DESC, rank, chunk_id) AS place FROM sim),
cand AS (SELECT *, CASE WHEN rank % 5 = 0 THEN 'too_long' ELSE 'evaluated' END AS status, similarity * 0.25::DOUBLE AS contradiction FROM top WHERE place <= 3)"""
SUPPORT = """, o AS (SELECT *, row_number() OVER (PARTITION BY response_id, claim_index ORDER BY CASE status WHEN 'evaluated' THEN 0 ELSE 1 END, entailment DESC, rank, chunk_id) AS n FROM cand),
sup AS (SELECT response_id, claim_index, max(CASE WHEN n = 1 AND status = 'evaluated' THEN entailment END) AS support, max(CASE WHEN n = 1 AND status = 'evaluated' THEN chunk_id END) AS support_chunk_id,
 max(CASE WHEN status = 'evaluated' THEN contradiction END) AS maximum_contradiction, CASE WHEN count(*) FILTER (WHERE status = 'evaluated') > 0 THEN 'evaluated' ELSE 'unevaluable' END AS status FROM o GROUP BY response_id, claim_index)"""
KEY = ["response_id", "claim_index"]


def candidates(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    context = turns.select("conv_id", F.col("turn").alias("ctx_turn"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), place.alias("rank"), G.word_set(F.col("text")).alias("s"))
    keyed = claims(spark, sf_dir).join(responses(spark, sf_dir).select("response_id", "conv_id", "turn"), "response_id")
    said = keyed.select(*KEY, "conv_id", "turn", G.word_set(F.col("text")).alias("c"))
    pairs = said.join(context, "conv_id").filter("ctx_turn < turn")
    # A turn without a text shares no word.
    both = F.coalesce(F.size(F.array_intersect("c", "s")), F.lit(0))
    scored = pairs.select(
        *KEY, "chunk_id", "rank",
        rounded_as_sql(G.jaccard(F.col("c"), F.col("s"))).alias("similarity"),
        rounded_as_sql(F.when(F.size("c") > 0, both / F.size("c")).otherwise(0.0)).alias("entailment"),
    )
    return G.top_candidates(scored, KEY).withColumns(
        {"status": F.when(F.col("rank") % 5 == 0, "too_long").otherwise("evaluated"), "contradiction": F.col("similarity") * 0.25}
    )


def support(spark, sf_dir):
    return G.claim_support(candidates(spark, sf_dir), KEY)


@query(f"{W} SELECT response_id, claim_index, s AS \"start\", e AS \"end\", t AS text FROM claims")
def claim_segments(spark, sf_dir):
    return claims(spark, sf_dir).select("response_id", "claim_index", "start", "end", "text")


@query(f"{W} SELECT CAST(count(*) AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE substr(r.response, s + 1, e - s) <> t) AS BIGINT) AS misplaced FROM claims JOIN responses r USING (response_id)")
def claim_offset_check(spark, sf_dir):
    placed = F.substring(F.col("response"), F.col("start") + 1, F.col("end") - F.col("start"))
    return claims(spark, sf_dir).agg(F.count(F.lit(1)).alias("claims"), F.count_if(placed != F.col("text")).alias("misplaced"))


@query(PAIRS + " SELECT response_id, claim_index, chunk_id, rank, similarity, CAST(place AS INTEGER) AS place FROM cand")
def claim_candidate_top3(spark, sf_dir):
    return candidates(spark, sf_dir).select(*KEY, "chunk_id", "rank", "similarity", "place")


@query(PAIRS + SUPPORT + " SELECT * FROM sup")
def claim_support_scores(spark, sf_dir):
    return support(spark, sf_dir)


@query(PAIRS + SUPPORT + """, j AS (SELECT r.response_id, s.* EXCLUDE (response_id) FROM responses r LEFT JOIN sup s ON s.response_id = r.response_id),
g AS (SELECT response_id, count(status) AS n, count(*) FILTER (WHERE status = 'evaluated') AS e, count(*) FILTER (WHERE status = 'evaluated' AND support < 0.4) AS u, avg(CASE WHEN status = 'evaluated' THEN support END) AS m, max(CASE WHEN status = 'evaluated' THEN maximum_contradiction END) AS c FROM j GROUP BY response_id)
SELECT response_id, CAST(n AS BIGINT) AS claims, CAST(e AS BIGINT) AS evaluated, CAST(u AS BIGINT) AS unsupported, round(m, 6) AS mean_support, c AS maximum_contradiction, CASE WHEN e > 0 THEN round(u::DOUBLE / e, 6) END AS unsupported_share, CASE WHEN n > 0 THEN e > 0 AND u = 0 AND e = n END AS fully_supported FROM g""")
def response_grounding(spark, sf_dir):
    every = responses(spark, sf_dir).select("response_id").join(support(spark, sf_dir), "response_id", "left")
    found = G.response_grounding(every, ["response_id"], 0.4)
    return found.withColumns({c: rounded_as_sql(F.col(c)) for c in ("mean_support", "unsupported_share")})


@query(PAIRS + SUPPORT + """, h AS (SELECT s.*, CASE WHEN length(c.t) % 4 = 0 THEN 1 ELSE 0 END AS human FROM sup s JOIN claims c ON c.response_id = s.response_id AND c.claim_index = s.claim_index WHERE s.status = 'evaluated')
SELECT response_id, CAST(max(human) AS INTEGER) AS truth, CAST(max(CASE WHEN support < 0.4 THEN 1 ELSE 0 END) AS INTEGER) AS prediction, round(max(1 - support), 6) AS unsupportedness FROM h GROUP BY response_id""")
def response_validation(spark, sf_dir):
    human = claims(spark, sf_dir).select(*KEY, (F.length("text") % 4 == 0).cast("int").alias("human_unsupported"))
    return rounded(G.response_validation(support(spark, sf_dir).join(human, KEY), ["response_id"], 0.4))


@query(f"""{W}, l AS (SELECT response_id, CAST(length(response) // 3 AS INTEGER) AS ls, CAST(length(response) // 3 + 20 AS INTEGER) AS le FROM responses)
SELECT c.response_id, c.claim_index, EXISTS (SELECT 1 FROM l WHERE l.response_id = c.response_id AND greatest(l.ls, c.s) < least(l.le, c.e)) AS flagged FROM claims c""")
def label_span_overlap(spark, sf_dir):
    third = (F.length("response") / 3).cast("int")
    labels = responses(spark, sf_dir).select("response_id", third.alias("start"), (third + 20).alias("end"))
    said = claims(spark, sf_dir).select(*KEY, "start", "end")
    return overlapping(said, labels, "response_id").select(*KEY, "flagged")


@query(r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_lines FROM s GROUP BY conv_id, turn""")
def response_lines(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines")
    )


@query("""WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rank, CAST(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS BIGINT) AS tokens FROM conversations),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) - tokens AS before FROM t) SELECT conv_id, rank, tokens, CAST(least(tokens, 120 - before) AS BIGINT) AS kept FROM b WHERE before < 120""")
def context_token_budget(spark, sf_dir):
    from pyspark.sql import Window

    from ragstone.functions.text import collapsed

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    chunks = table(spark, sf_dir, "conversations").select("conv_id", rank.alias("rank"), F.size(F.split(collapsed(F.col("text")), " ")).cast("long").alias("tokens"))
    return G.within_budget(chunks, ["conv_id"], 120)


@query()
def context_units_top3(spark, sf_dir):
    """Best segments per claim, distinct chunks first."""
    found = candidates(spark, sf_dir).select(*KEY, "chunk_id", "rank")
    texts = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.posexplode(sentences(F.col("text"))).alias("segment_index", "segment"))
    said = claims(spark, sf_dir).select(*KEY, G.word_set(F.col("text")).alias("c"))
    overlap = F.size(F.array_intersect("c", G.word_set(F.col("segment"))))
    segments = found.join(texts, "chunk_id").join(said, KEY).select(*KEY, "chunk_id", "rank", "segment_index", overlap.alias("overlap"))
    return G.context_units(segments, KEY)


@query()
def semantic_condition_scores(spark, sf_dir):
    """Claims scored against their candidate turns by the lexical stand-in for a model, then per response."""
    texts = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("premise"))
    said = claims(spark, sf_dir).select(*KEY, F.col("text").alias("claim"))
    pairs = candidates(spark, sf_dir).select(*KEY, "chunk_id").join(texts, "chunk_id").join(said, KEY)
    keyed = pairs.withColumns({"pair_key": F.sha2(F.concat_ws("|", F.sha2("claim", 256), "chunk_id"), 256), "unit_id": F.col("chunk_id")})
    best = G.best_unit(G.scored_pairs(keyed, G.lexical_scorer), KEY)
    return G.condition_scores(best, ["response_id"])


@query()
def rouge_l_scores(spark, sf_dir):
    return responses(spark, sf_dir).select("response_id", rouge_l_f1("response", "question").alias("rouge_l_f1"))


@query()
def extractive_answers(spark, sf_dir):
    shown = responses(spark, sf_dir).filter("question is not null").select("response_id", "question", F.col("response").alias("text"), F.lit(1).alias("rank"))
    return G.extractive_answer(shown, "response_id")


@query()
def packed_contexts(spark, sf_dir):
    packed = G.packed_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(packed).alias("pieces"), F.array_max(F.transform(packed, F.length)).alias("longest"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1 + event_id % 5 WHEN 1 THEN 1 + event_id % 5 WHEN 2 THEN 5 - event_id % 5 ELSE NULL END AS INTEGER) AS score FROM events""")
def judge_scores(spark, sf_dir):
    n = (1 + F.col("event_id") % 5).cast("string")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Score: "), n)).when(kind == 1, F.concat(n, F.lit("/5"))).when(kind == 2, F.concat(F.lit("Grade "), letter)).otherwise("no verdict")
    return table(spark, sf_dir, "events").select("event_id", judge_score(raw).alias("score"))
