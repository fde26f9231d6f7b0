import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ragstone.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {q for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for q in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_of_the_corpus(spark, corpus, sf):
    for r in Q.quality_report(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert tuple(r)[1:7] == brute(corpus[r.doc_id]) and not (r.base_failed and r.kept)


def test_verdicts_follow_the_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in Q.quality_report(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.1 * len(bad)


def test_clean_documents_alone_are_kept(spark):
    """Without junk to learn from, EM must not take a part of the good ones for bad."""
    texts = [(i, " ".join(f"Word{(i * 31 + j * 7) % 997} and some more text here." for j in range(30))) for i in range(200)]
    rows = Q.quality_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r.kept for r in rows if not r.base_failed)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a b", "a b c d a b c e a b", "", "x y z " * 200 + "end", "a b c\na b c\n\n \na b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.quality_report(rows).collect():
        assert tuple(r)[1:7] == brute(texts[r.doc_id])


def test_odd_rows(spark, odd, none):
    rows = Q.quality_report(odd).collect()
    assert len(rows) == 13 and all(tuple(r)[1:7] == brute(None) for r in rows if r.doc_id in (3, 4))
    kept = Q.filter_quality(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert Q.quality_report(none).collect() == [] and Q.filter_quality(none).collect() == []


def test_rates_are_estimated_from_the_votes(spark):
    """Votes drawn from known rates, among them a rule that knows nothing and one that is often wrong."""
    rng = random.Random(11)
    good = {"a": 0.02, "b": 0.01, "c": 0.3, "d": 0.05, "e": 0.15, "f": 0.03}
    bad = {"a": 0.6, "b": 0.4, "c": 0.3, "d": 0.7, "e": 0.8, "f": 0.35}
    rows = []
    for i in range(8000):
        rates = bad if i % 5 == 0 else good
        rows.append((i % 5 != 0, *[0 if rng.random() < 0.1 else -1 if rng.random() < rates[k] else 1 for k in good]))
    votes = spark.createDataFrame(rows, "truth boolean, " + ", ".join(f"{k} int" for k in good))
    fitted = Q.fit(votes, list(good), Q.QualityConfig(iterations=200))
    model = fitted.first().model
    assert abs(model.good - 0.8) < 0.03
    for i, k in enumerate(good):
        assert abs(model.on_good[i] - good[k]) < 0.03 and abs(model.on_bad[i] - bad[k]) < 0.08
    found = votes.crossJoin(fitted).withColumn("g", Q.posterior(F.col("model"), F.array(*good)) >= 0.5).cache()
    assert found.filter("g = truth").count() > 0.93 * len(rows)
    # All must pass would reject 45 % of the good ones for a bad vote of c or e alone.
    assert found.filter("truth and g and (c = -1 or e = -1)").count() > 0.8 * votes.filter("truth and (c = -1 or e = -1)").count()


def test_one_bad_vote_is_outvoted(spark, corpus, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = next(t for t in corpus.values() if len(t.split()) > 200 and brute(t)[2] == 0 and not brute(t)[5] and t.count("\n") < 20)
    words = plain.split(" ")
    loud = " ".join(w.upper() if i % 2 else w for i, w in enumerate(words))
    odd = spark.createDataFrame([(-1, loud)], "doc_id long, text string")
    row = Q.judged(docs.unionByName(odd), ["doc_id"]).filter("row.doc_id = -1").first().asDict()
    votes = [v for k, v in row.items() if k.startswith("vote_")]
    assert votes.count(-1) == 1 and row["vote_case"] == -1 and row["kept"]


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{i * 7 % 61} Some m{i * i}, stands k{i + 3}." for i in range(60)).replace("1", "ab").replace("3", "cd")
    docs = spark.createDataFrame([(1, text, 5, "x", True)], "doc_id long, text string, n_words int, row string, kept boolean")
    assert [tuple(r) for r in Q.filter_quality(docs).collect()] == [(1, text, 5, "x", True)]
