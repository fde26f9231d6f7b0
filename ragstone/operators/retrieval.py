"""Retrieval: inverted-index BM25, exact vector search, fusion, prefixes and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.text import tokens
from ragstone.session import shared_folder

from .governance import cache_key

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_CONSTANT = 60
DEPTHS = (1, 3, 5, 10)
#: Query postings up to which scoring goes by blocks, with the queries in every worker; beyond, by joins.
MOST_QUERY_POSTINGS = 1_000_000
#: Documents and cells (documents x terms, documents x questions) of a block.
BLOCK_DOCS, BLOCK_CELLS = 1024, 4_000_000
#: Numbers of the vectors that ask in one pass over the corpus, and similarities that a worker holds at once.
PASS_NUMBERS, PASS_CELLS = 16_000_000, 4_000_000


def tokenized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tokens, length."""
    return docs.select(key, tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))


def term_frequencies(tokened: DataFrame, key: str) -> DataFrame:
    """key, term, tf: the postings."""
    return tokened.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_lists(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, length, terms (distinct, in order of their first place), tfs: one row a document, made in one scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for own in batch.column("tokens").to_pylist():
                counted = Counter(own or ())
                lengths.append(len(own or ()))
                terms.append(list(counted))
                tfs.append(list(counted.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))],
                names=[key, "length", "terms", "tfs"],
            )

    named = docs.select(key, tokens(F.col(text)).alias("tokens"))
    return named.mapInArrow(count, f"{key} {dict(docs.dtypes)[key]}, length int, terms array<string>, tfs array<int>")


def idf_table(listed: DataFrame, terms: str = "terms") -> DataFrame:
    """term, df, idf: Okapi with negative values raised to a share of the mean over the vocabulary.

    listed: a row per document with its distinct terms, so the shuffle carries one row per term and task. The corpus
    figures are one row each."""
    frequency = listed.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = listed.agg(F.count(F.lit(1)).cast("double").alias("n"))
    raw = frequency.crossJoin(F.broadcast(corpus)).withColumn(
        "raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    floor = EPSILON * F.col("mean")
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """A written index: documents (key, length, terms, tfs), vocabulary (term, df, idf), corpus (one row: n, average)."""

    key: str
    documents: DataFrame
    vocabulary: DataFrame
    corpus: DataFrame


def index_of(docs: DataFrame, key: str, text: str = "text") -> Index:
    """The index as a plan, for tables that aren't files."""
    listed = term_lists(docs, key, text)
    corpus = listed.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("length").cast("double")).alias("average"))
    return Index(key, listed, idf_table(listed), corpus)


def bm25_index(docs: DataFrame, key: str, text: str = "text") -> Index:
    """The index of a table of files, made once: texts are tokenized in one scan, all else is read from the written lists.

    It stands in the shared folder under a name made of the files' names, sizes and times, so a later query, or another
    application on the same cluster, finds it there, and changed files make another one."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at"))
    named = sorted(map(list, files.distinct().collect()))
    place = f"{shared_folder(spark)}/bm25-{cache_key('bm25', {'key': key, 'text': text, 'files': named})}"
    parts = {name: f"{place}/{name}" for name in ("documents", "vocabulary", "corpus")}

    def written(name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{parts[name]}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def write(df: DataFrame, name: str) -> DataFrame:
        if not written(name):
            df.write.mode("overwrite").parquet(parts[name])
        return spark.read.schema(df.schema).parquet(parts[name])

    listed = write(index_of(docs, key, text).documents, "documents")
    corpus = listed.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("length").cast("double")).alias("average"))
    return Index(key, listed, write(idf_table(listed), "vocabulary"), write(corpus, "corpus"))


def oov_idf(n: Column) -> Column:
    """The idf of a term in no document."""
    return F.log((n + 0.5) / 0.5)


def asked_terms(questions: DataFrame, question: str) -> DataFrame:
    """question, term, qtf."""
    return (
        tokenized(questions, question)
        .select(question, F.explode("tokens").alias("term"))
        .groupBy(question, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(index: Index, questions: DataFrame, question: str) -> DataFrame:
    """question, key, score for documents that share a term with the question, by joins.

    Only postings of terms that some question has are spread. A term that a question repeats counts as often."""
    asked = asked_terms(questions, question).join(index.vocabulary.select("term", "idf"), "term")
    pairs = F.explode(F.arrays_zip("terms", "tfs"))
    postings = index.documents.select(index.key, "length", pairs.alias("p")).select(
        index.key, "length", F.col("p.terms").alias("term"), F.col("p.tfs").cast("double").alias("tf")
    )
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return (
        postings.join(asked.select("term").distinct(), "term", "left_semi")
        .crossJoin(F.broadcast(index.corpus.select("average")))
        .select(index.key, "term", saturated.alias("part"))
        .join(asked, "term")
        .groupBy(question, index.key)
        .agg(F.sum(F.col("part") * F.col("idf") * F.col("qtf")).alias("score"))
    )


def bm25_candidates(index: Index, questions: DataFrame, question: str, k: int) -> DataFrame:
    """question, key, score: enough of bm25_scores() to hold every question's k best, and all scores of the first k keys.

    With few queries their weights are a small matrix. Each task multiplies blocks of its documents' term weights with
    it and keeps the k best of a block and those that come within a rounding of them, so what is shuffled is about k rows
    per block and question instead of a row per shared term. The number of query postings is counted first; with too
    many, or with questions that a block can't hold, scores come from bm25_scores()."""
    key = index.key
    asked = asked_terms(questions, question).join(index.vocabulary.select("term", "idf"), "term")
    postings = asked.limit(MOST_QUERY_POSTINGS + 1).toArrow()
    names, wanted = sorted(set(postings.column(question).to_pylist())), sorted(set(postings.column("term").to_pylist()))
    if postings.num_rows > MOST_QUERY_POSTINGS or len(wanted) * len(names) > BLOCK_CELLS:
        return bm25_scores(index, questions, question)
    average = index.corpus.first()["average"]
    first = {r[0] for r in index.documents.select(key).orderBy(key).limit(k).collect()}
    place, where = {t: i for i, t in enumerate(wanted)}, {q: i for i, q in enumerate(names)}
    asks = np.array([where[q] for q in postings.column(question).to_pylist()], np.int64)
    terms = np.array([place[t] for t in postings.column("term").to_pylist()], np.int64)
    weights = postings.column("qtf").to_numpy() * postings.column("idf").to_numpy()
    size = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(1, len(place), len(names))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_of = np.zeros((len(place), len(names)))
        asked_of[terms, asks] = weights
        touched = None
        if not (weights > 0).all():  # a shared term may then add nothing to a score
            touched = np.zeros(asked_of.shape, np.float32)
            touched[terms, asks] = 1
        known = pa.array(wanted, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                block = batch.slice(start, size)
                lists = block.column("terms")
                found = pc.index_in(lists.flatten(), value_set=known)
                there = pc.is_valid(found).to_numpy(zero_copy_only=False)
                doc = pc.list_parent_indices(lists).to_numpy()[there]
                at = found.drop_null().to_numpy()
                tf = block.column("tfs").flatten().to_numpy()[there]
                lengths = block.column("length").to_numpy()
                # Only cells of terms that a document has are worked out; all others stay 0.
                saturated = np.zeros((block.num_rows, len(place)))
                saturated[doc, at] = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / average))[doc])
                scores = saturated @ asked_of
                shared = scores > 0 if touched is None else (saturated > 0).astype(np.float32) @ touched > 0
                ordered = np.where(shared, scores, -np.inf)
                least = np.partition(ordered, -min(k, block.num_rows), axis=0)[-min(k, block.num_rows)] - 2e-6
                early = np.array([x in first for x in block.column(key).to_pylist()])
                doc, asks_ = np.nonzero(shared & ((ordered >= least) | early[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[j] for j in asks_], postings.schema.field(question).type),
                        block.column(key).take(pa.array(doc)),
                        pa.array(scores[doc, asks_], pa.float64()),
                    ],
                    names=[question, key, "score"],
                )

    kind = dict(index.documents.dtypes)[key]
    return index.documents.mapInArrow(score, f"{question} {dict(questions.dtypes)[question]}, {key} {kind}, score double")


def ranked(scores: DataFrame, group: str | list[str], key: str, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each group by (-score, key), with rank; scores are compared at `digits` places, so that the order
    doesn't hang on the order of summation. Spark keeps k rows a group before the shuffle (WindowGroupLimit)."""
    groups = [group] if isinstance(group, str) else group
    order = Window.partitionBy(*groups).orderBy(F.desc(score), key)
    return (
        scores.withColumn(score, F.round(score, digits))
        .filter(~F.isnan(score) & F.col(score).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def padded_top_k(scores: DataFrame, docs: DataFrame, questions: DataFrame, question: str, key: str, k: int) -> DataFrame:
    """ranked(), with the first documents by key at score 0 where fewer than k share a term: they're legal hits."""
    first = docs.select(key).orderBy(key).limit(k)
    zeros = questions.select(question).crossJoin(F.broadcast(first)).join(scores, [question, key], "left_anti")
    return ranked(scores.select(question, key, "score").unionByName(zeros.withColumn("score", F.lit(0.0))), question, key, k)


def exact_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank by dot product; vectors that are null, or of another length than those that ask, are
    in no result.

    Every pass over the corpus multiplies its batches with at most PASS_NUMBERS numbers of queries, which travel with the
    function, and keeps the k best of a batch and those within a rounding of them, so k rows per batch and query are
    shuffled. Queries beyond a pass go into further passes by a hash of their id."""
    asked = queries.filter("embedding is not null").select("vec_id", "embedding")
    numbers, longest = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.max(F.size("embedding"))).first()
    passes = max(1, -(-numbers // PASS_NUMBERS))
    found = [_searched(asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i), corpus, k) for i in range(passes)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return ranked(every, "query_id", "vec_id", k)


def _searched(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    rows = asked.toArrow()
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    vectors = [np.array(x, np.float64) for x in rows.column("embedding").to_pylist()]
    for n in sorted({len(v) for v in vectors}):
        own = [i for i, v in enumerate(vectors) if len(v) == n]
        by_size[n] = (rows.column("vec_id").take(pa.array(own)).to_pylist(), np.array([vectors[i] for i in own]).T.reshape(n, len(own)))
    kind = rows.schema.field("vec_id").type

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PASS_CELLS // max(1, rows.num_rows))
            for start in range(0, batch.num_rows, step):
                block = batch.slice(start, step)
                sizes = pc.fill_null(pc.list_value_length(block.column("embedding")), -1).to_numpy()
                for n, (names, matrix) in by_size.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    flat = block.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    scores = flat.reshape(len(at), n) @ matrix
                    ordered = np.where(np.isnan(scores), -np.inf, scores)
                    place = min(k, len(at))
                    least = np.partition(ordered, -place, axis=0)[-place] - 2e-6
                    row, query = np.nonzero((ordered >= least) & ~np.isnan(scores))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[j] for j in query], kind), block.column("vec_id").take(pa.array(at[row])), pa.array(scores[row, query], pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    ids = dict(asked.dtypes)["vec_id"]
    schema = f"query_id {ids}, vec_id {dict(corpus.dtypes)['vec_id']}, score double"
    return corpus.select("vec_id", "embedding").mapInArrow(search, schema)


def fused(first: DataFrame, second: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two rankings (group, key, rank)."""
    part = lambda df, name: df.select(group, key, F.col("rank").alias(name))
    gain = lambda name: F.coalesce(1.0 / (RRF_CONSTANT + F.col(name)), F.lit(0.0))
    both = part(first, "first_rank").join(part(second, "second_rank"), [group, key], "full_outer")
    return ranked(both.withColumn("score", gain("first_rank") + gain("second_rank")), group, key, k, digits=9)


def minmax(value: str, group: str) -> Column:
    """To [0, 1] within the group; 0 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def blended(first: DataFrame, second: DataFrame, group: str, key: str, k: int, alpha: float = 0.6) -> DataFrame:
    """Linear hybrid of two scored lists after min-max normalization over each group's candidates."""
    both = (
        first.select(group, key, F.col("score").alias("a"))
        .join(second.select(group, key, F.col("score").alias("b")), [group, key], "full_outer")
        .fillna(0.0, ["a", "b"])
    )
    scored = both.withColumns({"na": minmax("a", group), "nb": minmax("b", group)})
    return ranked(scored.withColumn("score", alpha * F.col("na") + (1 - alpha) * F.col("nb")), group, key, k)


def prefixes(hits: DataFrame, group: str, key: str, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """group, k, keys: the first k keys of each ranking, in order."""
    spark = hits.sparkSession
    ks = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in depths])).alias("k"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key])
    return hits.crossJoin(F.broadcast(ks)).filter("rank <= k").groupBy(group, "k").agg(ordered.alias("keys"))


def ranking_metrics(conditions: DataFrame, gold: DataFrame, group: str, key: str) -> DataFrame:
    """group, k, recall, reciprocal_rank; null for groups without gold keys, never 0."""
    truth = gold.groupBy(group).agg(F.collect_set(key).alias("gold"))
    place = F.array_min(F.filter(F.transform("gold", lambda g: F.array_position("keys", g)), lambda p: p > 0))
    known = F.size("gold") > 0
    return (
        conditions.join(truth, group, "left")
        .withColumn("place", place)
        .select(
            group,
            "k",
            F.when(known, F.when(F.col("place").isNotNull(), 1).otherwise(0)).alias("recall"),
            F.when(known, F.coalesce(1.0 / F.col("place"), F.lit(0.0))).alias("reciprocal_rank"),
        )
    )


def retrieval_summary(metrics: DataFrame, deepest: int = DEPTHS[-1]) -> DataFrame:
    """k, questions, mean_recall, mrr_at_10: the mean reciprocal rank is the deepest prefix's, on every row."""
    scored = metrics.filter("recall is not null")
    deep = scored.filter(F.col("k") == deepest).agg(F.avg("reciprocal_rank").alias("mrr_at_10"))
    return (
        scored.groupBy("k")
        .agg(F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("mean_recall"))
        .crossJoin(F.broadcast(deep))
    )
