import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ragstone.llm import fingerprint as P


def brute(docs):
    """docs: (id, text), ids known and unique."""
    rows = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_neighbours_of_the_corpus(spark, corpus, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.compare_with_next(docs, P.SketchConfig(bucket_rows=rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute(corpus.items())
    by_text = {}
    for r in got:
        assert by_text.setdefault(corpus[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def hashes_of(text):
    """63-bit hashes of the five-word shingles, by the published XXH64 with each word's hash as the seed of the next."""
    words = [w.encode() for w in (text or "").replace("\x0b", " ").replace("\f", " ").split()] if text else []
    words = (text or "").encode().split()
    runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([[b" ".join(words)]] if words else [])
    out = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w, seed=h)
        out.add(h & P.LARGEST)
    return out


def brute_sketch(hashes, scale=8):
    return sorted(h for h in hashes if h <= P.LARGEST // scale) or sorted(hashes)[:1]


def brute_likeness(a, b):
    small, large = sorted((set(a), set(b)), key=len)
    return len(small & large) / len(small) if small else float(not large)


def test_hashes_and_likenesses_of_the_corpus(spark, corpus, sf):
    got = {r.doc_id: r for r in P.compare_with_next(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    order = sorted(corpus, reverse=True)
    for k, i in enumerate(order):
        text, after = corpus[i] or "", corpus[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        own, edited, other = (brute_sketch(hashes_of(t)) for t in (text, text[: len(text) - half] + after[:half], after))
        assert got[i].fingerprint == "".join(f"{h:016x}" for h in own)
        assert got[i].edited_fingerprint == "".join(f"{h:016x}" for h in edited)
        assert abs(got[i].near_edited - brute_likeness(own, edited)) < 1e-12
        assert abs(got[i].near_next - brute_likeness(own, other)) < 1e-12


def test_merging_sketches_is_the_sketch_of_both(spark):
    """Also for short texts, whose sketches are often a lone hash above the threshold."""
    rng = random.Random(2)
    texts = [" ".join(f"m{rng.randrange(10**6)}" for _ in range(rng.choice((0, 1, 4, 6, 8, 12, 20, 200)))) for _ in range(120)]
    pairs = spark.createDataFrame(list(zip(texts[::2], texts[1::2])), "a string, b string")
    stand_ins = 0
    for r in pairs.select("a", "b", P.merged(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("m")).collect():
        assert r.m == brute_sketch(hashes_of(r.a) | hashes_of(r.b))
        stand_ins += bool(r.m) and r.m[0] > P.LARGEST // 8
    assert stand_ins > 3


def sketch_of(spark, text, scale=8):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(P.sketch(F.col("t"), P.SketchConfig(scale=scale))).first()[0]


def test_sketches_keep_all_small_hashes_and_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(900))
    every, some = sketch_of(spark, a, 1), sketch_of(spark, a, 8)
    assert some == [h for h in every if h <= ((1 << 63) - 1) // 8] and 70 < len(some) < 160
    df = spark.createDataFrame([(sketch_of(spark, a), sketch_of(spark, b))], "a array<long>, b array<long>")
    both = df.select(P.merged(F.col("a"), F.col("b")).alias("m"), P.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert both.m == sorted({*sketch_of(spark, a), *sketch_of(spark, b)}) and both.c == 0
    assert abs(len(set(sketch_of(spark, a + " " + b)) & set(some)) - len(some)) <= 1


def test_a_short_text_inside_a_long_one(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words[1000:1200]), " ".join(words))], "a string, b string")
    row = df.select(P.containment(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("in_"), P.containment(P.sketch(F.col("b")), P.sketch(F.col("a"))).alias("of")).first()
    assert row.in_ >= 0.95 and row.of < 0.15


def test_odd_rows(spark, odd, none):
    rows = P.compare_with_next(odd, P.SketchConfig(bucket_rows=2)).collect()
    assert len(rows) == 13
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert {(r.n_chars, r.fingerprint) for r in empty} == {(0, "")}
    assert P.compare_with_next(none).collect() == []
    lone = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    row = P.compare_with_next(lone).first()
    text = "a b c d e f g h"
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256((text[:8] + text[:7]).encode()).hexdigest()
