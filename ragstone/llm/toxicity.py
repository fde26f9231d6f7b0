"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words in lower case (runs of letters) and their first four to seven bytes, which carry over to
forms not seen in training, hashed to `buckets` numbers. Training sees at most about `train_docs` labelled documents, a bounded sample by
a hash of the id. Of their terms the `features` most telling ones stay, by the two-sided z-score of a term's share among
toxic and other documents. The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>: a pair of terms may weigh more or
less than its parts, such as an insult next to the mention of a group. It is fitted by Adam on the log loss with L2.

A score reads the text and nothing else. The model, features * (factors + 1) numbers, travels with the function.

Edge cases: a null or empty text has no terms and gets the score of the bias; labels that are null or whose document is
missing don't count; several labels of one document count each; without labels of both kinds the score is `no_label`
throughout; repeated rows score alike; null ids are never held out; an empty table gives an empty table; further
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import U, hash_sums, piece_hashes, runs_of

PREFIXES = (4, 5, 6, 7)
LARGEST = (1 << 63) - 1
SLICE = 1 << 20
#: ASCII letters and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class ToxicityConfig:
    folds: int = 5
    train_docs: int = 20_000
    buckets: int = 1 << 18
    features: int = 4096
    least_documents: int = 5
    least_z: float = 3.5
    factors: int = 8
    epochs: int = 120
    rate: float = 0.05
    l2: float = 1e-4
    seed: int = 7
    no_label: float = 0.05


def text_terms(text: str | None, buckets: int, keep: np.ndarray | None = None) -> np.ndarray:
    """The distinct terms of a text, ascending; with keep (a flag per bucket), only those it has.

    All words and prefixes of a text are hashed at once; a text beyond a slice is cut between words."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    found, start = [np.empty(0, np.int64)], 0
    while start < len(data):
        end = min(len(data), start + SLICE)
        while end < len(data) and LETTER[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - start, start)
        starts, ends = runs_of(raw, LETTER)
        sums = hash_sums(raw)
        for n in (0, *PREFIXES):
            fits = slice(None) if not n else ends - starts >= n
            s = starts[fits]
            terms = ((piece_hashes(sums, s, s + n if n else ends) ^ U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(buckets)).astype(np.int64)
            found.append(terms if keep is None else terms[keep[terms]])
        start = end
    return np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # ascending; row i of weights and factors belongs to terms[i]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        """The probability for a text with these terms, all of which the model has."""
        at = np.searchsorted(self.terms, terms)
        v = self.factors[at]
        margin = self.bias + self.weights[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_machine(
    rows: list[np.ndarray], labels: np.ndarray, times: np.ndarray, n: int, config: ToxicityConfig
) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) from rows of feature numbers in [0, n), each of which counts `times`."""
    at = np.concatenate([np.append(r, n) for r in rows]).astype(np.int64)  # n: a feature of weight 0, so no row is empty
    sizes = np.array([len(r) + 1 for r in rows])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(at, kind="stable")
    heads = np.flatnonzero(np.diff(np.concatenate([[-1], at[order]])))
    there = at[order][heads]
    rng = np.random.default_rng(config.seed)
    share = (labels * times).sum() / times.sum()
    params = [
        np.array([np.log(share / (1 - share))]),
        np.zeros(n + 1),
        rng.normal(0, 0.01, (n + 1, config.factors)),
    ]
    params[2][n] = 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, config.epochs + 1):
        v = params[2][at]
        sums = np.add.reduceat(v, starts)
        margin = params[0][0] + np.add.reduceat(params[1][at], starts) + 0.5 * (sums**2 - np.add.reduceat(v**2, starts)).sum(1)
        slope = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels) * times / times.sum()
        each = slope[owner]
        by_weight, by_factor = np.zeros(n + 1), np.zeros_like(params[2])
        by_weight[there] = np.add.reduceat(each[order], heads)
        by_factor[there] = np.add.reduceat((each[:, None] * (sums[owner] - v))[order], heads)
        grads = [np.array([slope.sum()]), by_weight + config.l2 * params[1], by_factor + config.l2 * params[2]]
        grads[1][n], grads[2][n] = 0, 0
        for p, g, (m1, m2) in zip(params, grads, moments):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            p -= config.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1][:n], params[2][:n]


def _term_counts(docs: DataFrame, config: ToxicityConfig) -> DataFrame:
    """term, toxic, all: documents with the term, from docs (text, label); term -1 is in all. Counted by batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.zeros((2, config.buckets + 1), np.int64)
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                terms = text_terms(text, config.buckets)
                both[1, terms] += 1
                both[1, -1] += 1
                if label:
                    both[0, terms] += 1
                    both[0, -1] += 1
            seen = np.flatnonzero(both[1])
            names = np.where(seen == config.buckets, -1, seen)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(both[0, seen]), pa.array(both[1, seen])], names=["term", "toxic", "all"])

    counted = docs.select("text", "label").mapInArrow(count, "term long, toxic long, all long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))


def _kept_terms(docs: DataFrame, config: ToxicityConfig, keep: np.ndarray) -> DataFrame:
    """label, terms (positions in keep), times: documents with equal labels and terms are one row."""
    flags = _flags(keep, config.buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.searchsorted(keep, text_terms(t, config.buckets, flags)).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "terms"])

    found = docs.select("text", "label").mapInArrow(find, "label int, terms array<int>")
    return found.groupBy("label", "terms").agg(F.count(F.lit(1)).alias("times"))


def _flags(terms: np.ndarray, buckets: int) -> np.ndarray:
    flags = np.zeros(buckets, bool)
    flags[terms] = True
    return flags


def sample_limit(labelled: int, config: ToxicityConfig) -> int:
    """Labelled rows whose 63-bit hash is at most this are the sample: all of them, or about train_docs of any number."""
    return LARGEST * min(labelled, config.train_docs) // max(1, labelled)


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Model | None:
    """The model, or None without labels of both kinds. The sample is broadcast: it has about train_docs rows."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"), config.folds))
    order = F.xxhash64("doc_id", F.lit(config.seed)).bitwiseAND(F.lit(LARGEST))
    chosen = usable.filter(order <= F.lit(sample_limit(usable.count(), config))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = _term_counts(sample, config).filter((F.col("all") >= config.least_documents) | (F.col("term") == -1))
    counts = staged(counted, "toxicity-counts")
    total = counts.filter("term = -1").first()
    if total is None or total["toxic"] in (0, total["all"]):
        return None
    p, q = float(total["toxic"]), float(total["all"] - total["toxic"])
    a, b = (F.col("toxic") + 0.5) / (p + 1), (F.col("all") - F.col("toxic") + 0.5) / (q + 1)
    pooled = F.col("all") / (p + q)
    z = F.abs(a - b) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / p + 1 / q))
    telling = counts.filter("term >= 0").withColumn("z", z).filter(F.col("z") >= config.least_z)
    keep = np.sort(
        np.array([r["term"] for r in telling.orderBy(F.desc("z"), "term").limit(config.features).collect()], np.int64)
    )
    # At most about train_docs short lists of positions come to the driver, in an order that reruns agree on.
    got = _kept_terms(sample, config, keep).orderBy("label", "terms").toArrow()
    rows = [np.array(r, np.int64) for r in got.column("terms").to_pylist()]
    labelled, times = (np.array(got.column(c).to_pylist(), np.float64) for c in ("label", "times"))
    bias, weights, factors = fit_machine(rows, labelled, times, len(keep), config)
    return Model(keep, bias, weights, factors)


def toxicity_scores(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, config)
    rows = docs.select("doc_id", "text")
    if model is None:
        scored = rows.select("doc_id", F.lit(config.no_label).alias("score"))
    else:
        flags = _flags(model.terms, config.buckets)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [model.score(text_terms(t, config.buckets, flags)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
                )

        scored = rows.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), config.folds).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
