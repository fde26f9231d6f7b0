import zlib

import numpy as np

from ragstone.llm.toxicity import LARGEST, ToxicityConfig, fit_machine, sample_limit, text_terms, toxicity_scores, train


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")  # the smaller tables hold out too few toxic documents to tell
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y > z]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum(y == 0 and a >= 0.5 for a, y in held) <= 2 and sum(y == 1 and a >= 0.5 for a, y in held) > 0.8 * sum(y for _, y in held)


def test_labels_of_held_out_rows_dont_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_pairs_of_terms_are_learned():
    """Either term alone is harmless, both together are not: no sum of weights separates that."""
    rows = [np.array(x, np.int64) for x in ([], [0], [1], [0, 1])] * 50
    labels = np.array([0.0, 1.0, 1.0, 0.0] * 50)
    bias, w, v = fit_machine(rows, labels, np.ones(200), 2, ToxicityConfig(epochs=600))
    margin = [bias + w[r].sum() + 0.5 * (v[r].sum(0) ** 2 - (v[r] ** 2).sum(0)).sum() for r in rows[:4]]
    assert margin[1] > 0 and margin[2] > 0 and margin[0] < 0 and margin[3] < 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert len(toxicity_scores(odd, labels).collect()) == 13
    assert {r.score for r in toxicity_scores(odd, labels.limit(0)).collect()} == {ToxicityConfig().no_label}
    assert toxicity_scores(none, labels).collect() == []


def test_terms_are_whole_text():
    a = text_terms("Moron " + "x " * 2_000_000 + "moronic", 1 << 18)
    assert set(text_terms("moron", 1 << 18)) <= set(a) and set(text_terms("moronic", 1 << 18)) <= set(a)
    assert len(text_terms(None, 8)) == 0


def test_the_sample_is_never_empty():
    config = ToxicityConfig()
    assert sample_limit(0, config) == 0 and sample_limit(500, config) == sample_limit(20_000, config) == LARGEST
    for n in (10**6, 2 * 10**8 + 1, 10**12):
        assert abs(n * sample_limit(n, config) / LARGEST - config.train_docs) < 1


def test_a_small_share_of_many_labels_still_trains(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    many = labels.selectExpr("doc_id", "toxic", "explode(sequence(1, 60)) as again")
    assert train(docs, many, ToxicityConfig(train_docs=100 * 60, epochs=2, least_documents=1)) is not None


def brute_score(model, text):
    """The machine's formula, term by term and pair by pair."""
    at = [int(np.searchsorted(model.terms, t)) for t in text_terms(text, ToxicityConfig().buckets) if t in set(model.terms.tolist())]
    margin = model.bias + sum(model.weights[i] for i in at)
    margin += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[:k])
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def test_scores_follow_the_formula(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    config = ToxicityConfig(least_z=0.5, features=300, epochs=20)
    model = train(docs, labels, config)
    assert model is not None and len(model.terms) > 50
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity_scores(docs, labels, config).collect():
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-9
