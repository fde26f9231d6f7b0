import hashlib
import random

import numpy as np

from ragstone.llm.substring import SubstringConfig, dedup_substrings, spans_of, substring_report
from ragstone.llm.words import anchors, mixed, multipliers, run_hashes, split_words, word_hashes


def brute(docs, length=13):
    """docs: (doc_id, text), ids known."""
    first = {}
    for i, t in docs:
        w = split_words(t)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = split_words(t)
        covered = {q for p in range(len(w) - length + 1) if first[tuple(w[p : p + length])] < i for q in range(p, p + length)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in covered)
        out.append((i, len(w), len(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_like_brute_force_on_the_corpus(spark, corpus, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(substring_report(docs)) == brute(corpus.items())


def test_shared_passages_of_every_length(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 25, 60)]
    docs = []
    for i in range(60):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(3)]
        docs.append((i * 7 % 61, " ".join(sum([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]], []))))
    # Every document is in the sample and most passages are hot, so both ways are taken.
    hot = SubstringConfig(hot_share=10.0)
    crowded = SubstringConfig(hot_share=10.0, crowd=3)
    for config in (SubstringConfig(), SubstringConfig(sample_docs=4, hot_share=0.5), hot, crowded):
        assert got(substring_report(spark.createDataFrame(docs, "doc_id long, text string"), config)) == brute(docs)


def test_odd_rows(spark, odd, none):
    rows = substring_report(odd).collect()
    assert len(rows) == 13
    assert sorted(r.n_removed for r in rows if r.doc_id == 2) == [20, 20]
    assert all(r.n_removed == 0 for r in rows if r.doc_id not in (2,))
    assert {r.n_words for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert substring_report(none).collect() == []


def test_spans_are_maximal(spark):
    assert spans_of(np.array([0, 1, 5, 18, 32]), 13) == [(0, 31), (32, 45)]
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, f"a {text} b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in dedup_substrings(docs).collect()}
    assert [(s.start, s.end) for s in rows[2].spans] == [(1, 31)] and rows[2].kept_text == "a b"


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 200, dtype=np.uint64)
    both = np.concatenate([rng.integers(0, 2**63, 50, dtype=np.uint64), h[100:113], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    a, b = (anchors(run_hashes(x, 5, 1), 9) for x in (h, both))
    assert a[100] - 100 == b[50] - 50


def test_word_hashes_follow_words_alone():
    a, b = word_hashes("one two  three\x0btwo"), word_hashes("two")
    assert len(a) == 4 and a[1] == a[3] == b[0] and len({*a.tolist()}) == 3


def test_windows_around_one_anchor_that_share_32_bits_stay(spark):
    draw = np.random.default_rng(3)
    words = np.array([f"v{i}" for i in range(3000)])
    hashes = word_hashes(" ".join(words))
    seed = int(run_hashes(hashes, 5, 1).argmin())
    rows = draw.integers(0, len(words), (400_000, 13))
    rows[:, 4:9] = np.arange(seed, seed + 5)
    check = mixed((hashes[rows] * multipliers(13, 3)).sum(1, dtype=np.uint64)) >> np.uint64(32)
    order = np.argsort(check)
    same = np.flatnonzero(np.diff(check[order]) == 0)
    pairs = [(" ".join(words[rows[order[i]]]), " ".join(words[rows[order[i + 1]]])) for i in same]
    pairs = [p for p in pairs if all(list(anchors(run_hashes(word_hashes(t), 5, 1), 9)) == [4] for t in p) and p[0] != p[1]]
    assert pairs
    docs = [(i, t) for i, t in enumerate(pairs[0])]
    assert got(substring_report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_keys_that_many_batches_share(spark):
    """A key whose rows fill several batches: only its distinct windows are kept from one to the next."""
    rng = random.Random(5)
    seed = " ".join(f"s{i}" for i in range(25))
    docs = [(i * 37 % 3001, f"{rng.randrange(10**6)} {seed} {rng.choice('xyz')} {rng.randrange(10**6)}") for i in range(3001)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for config in (SubstringConfig(hot_share=10.0), SubstringConfig(hot_share=10.0, crowd=100)):
            assert got(substring_report(spark.createDataFrame(docs, "doc_id long, text string"), config)) == brute(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
