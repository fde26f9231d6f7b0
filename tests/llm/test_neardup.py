import dataclasses
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragstone.llm import neardup as N


def shingle_set(text, weights="count"):
    """Shingles, numbered by occurrence if their counts are weights."""
    w = (text or "").encode().split()
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])
    return frozenset((s, k) for s, n in counts.items() for k in range(n if weights == "count" else 1))


def brute(docs, similarity=0.8, weights="count"):
    """docs: id -> text; the smallest id of each class."""
    sets = {i: shingle_set(t, weights) for i, t in docs.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    heads = {min(v): s for s, v in by.items()}
    parent = {i: i for i in heads}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in heads.items():
        for x in s:
            where[x].append(i)
    pairs = defaultdict(int)
    for ids in where.values():
        for j, b in enumerate(ids):
            for a in ids[:j]:
                pairs[a, b] += 1
    for (a, b), n in pairs.items():
        if n >= similarity * (len(heads[a]) + len(heads[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(min(by[s])) for i, s in sets.items()}


def got(spark, docs, config=N.NearConfig()):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in N.near_classes(df, config).collect()}


@pytest.mark.parametrize("weights", ["set", "count"])
def test_like_brute_force_on_the_corpus(spark, corpus, sf, weights):
    rows = N.near_classes(spark.read.parquet(f"{sf}/documents.parquet"), N.NearConfig(weights=weights)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(corpus, weights=weights)


def test_recall_and_precision_on_more_documents(spark, sf):
    """Every link of the exact answer, planted edits included, is found, and none is made up."""
    rng = random.Random(12)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    long = [i for i, t in docs.items() if len((t or "").split()) >= 100]
    for k in range(200):
        i = rng.choice(long)
        words = docs[i].split()
        docs[10**6 + k] = edited(rng, words, max(1, int(len(words) * rng.uniform(0.002, 0.03))))
    want, found = brute(docs), got(spark, docs)
    copies = [i for i, c in want.items() if c != i]
    assert len(copies) > 150
    assert sum(found[i] == want[i] for i in copies) >= 0.999 * len(copies)
    assert all(found[i] == i for i, c in want.items() if c == i)


def test_counts_are_weights(spark):
    """Equal sets of shingles whose counts differ are not alike; without weights they would be one class."""
    line, other = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = {1: f"{line} " * 40 + other, 2: f"{line} " + f"{other} " * 40, 3: f"{line} " * 38 + other}
    assert got(spark, docs) == brute(docs) == {1: 1, 2: 2, 3: 1}
    assert len(set(brute({1: f"{line} {line} {line}", 2: f"{line} {line}"}, weights="set").values())) == 1
    assert got(spark, {1: f"{line} {line} {line}", 2: f"{line} {line}"}, N.NearConfig(weights="set")) == {1: 1, 2: 1}


def test_a_null_id_beside_a_near_copy(spark):
    rng = random.Random(9)
    words = [f"n{i}" for i in range(300)]
    rows = [(None, " ".join(words)), (None, edited(rng, words, 2)), (5, edited(rng, words, 3)), (None, None), (6, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in N.near_classes(docs).collect()) == [(0, 0)] * 3 + [(5, 5), (6, 6)]
    assert sorted(str(r.doc_id) for r in N.keep_one(docs).collect()) == ["5", "6", "None"]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "x y", "r", 7, 8)], "doc_id long, text string, row string, t long, id long")
    assert [tuple(r) for r in N.keep_one(docs).collect()] == [(1, "x y", "r", 7, 8)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("leaders", [4, 1024])
def test_groups_whose_copies_are_less_alike_than_the_links(spark, leaders):
    """Copies of one text with few and many edits: most are linked only through others, and many only nearly."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = {500 + i: edited(rng, base, rng.choice((1, 2, 3, 4, 5, 8))) for i in range(120)}
    docs[3] = " ".join(base)
    common = " ".join(f"c{i}" for i in range(60))
    docs.update({1000 + i: f"{common} " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(20, 90))) for i in range(80)})
    config = dataclasses.replace(N.NearConfig(), leaders=leaders, part=16)
    assert got(spark, docs, config) == brute(docs)


def test_chains_are_one_class(spark):
    words = [f"w{i}" for i in range(300)]
    docs = {i: " ".join(words[8 * i : 8 * i + 180]) for i in range(14)}
    assert set(got(spark, docs).values()) == {0} == set(brute(docs).values())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))[:300]
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for seed in range(20):
        config = N.NearConfig(weights="count", seed=seed)
        x, y = N.signatures([(elements, a), (elements, b)], config)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - truth) < 0.04


def test_signatures_dont_depend_on_the_batch():
    rng = np.random.default_rng(6)
    sets = [(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), np.ones(n, int)) for n in (1, 2, 40, 3000, 0)]
    config = N.NearConfig()
    together = N.signatures(sets, config)
    for i, s in enumerate(sets):
        assert (N.signatures([s], config)[0] == together[i]).all()
    assert (together[:4] != 0).all() and (together[4] == 0).all()


def test_odd_rows(spark, odd, none):
    rows = N.near_classes(odd).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert len(rows) == 13 and by[1] == by[2] and by[3] == by[4] == by[5] and all(len(v) == 1 for v in by.values())
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {1, 3, 6, 7, 8, 9, 10}
    assert N.near_classes(none).collect() == [] and N.keep_one(none).collect() == []


def test_rows_without_an_id_or_with_one_id_stay_by_their_texts(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(None, text(x)) for x in "abcdef"] + [(None, text("a")), (None, text("b") + " more")]
    rows += [(1, text("g")), (1, text("h")), (2, text("h")), (3, text("c")), (4, text("d") + " more"), (5, text("c") + " more"), (1, text("g"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in N.keep_one(docs).collect())
    b = [t for i, t in kept if not i and t.startswith("b0 ")]
    assert len(b) == 1 and b[0] in (text("b"), text("b") + " more")
    assert kept == sorted([(0, text("a")), (0, b[0]), (0, text("e")), (0, text("f")), (1, text("g")), (1, text("h")), (3, text("c")), (4, text("d") + " more")])
    classes = sorted((r.doc_id or 0, r.class_id or 0) for r in N.near_classes(docs).collect())
    assert classes == [(0, 0)] * 8 + [(1, 1)] * 3 + [(2, 1), (3, 3), (4, 4), (5, 3)]


def test_workers_get_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    long = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "bytes long")
    got = [r.bytes for r in N.staged(long, "sizes").collect()]
    assert sum(got) >= 20_000_000 and max(got) < 2 * N.BATCH_BYTES
    assert spark.conf.get(name, None) == before
