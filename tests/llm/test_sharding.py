import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragstone.llm import sharding as H


def brute_capacity(sizes, k):
    """The smallest capacity by trying every contiguous sum."""
    best = None
    for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        n, room = 0, 0
        for s in sizes:
            if s > c:
                n = k + 1
                break
            if s > room:
                n, room = n + 1, c
            room -= s
        if n <= k:
            best = c
            break
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 5, 24])
def test_capacity_and_cuts_are_minimax(spark, k):
    rng = random.Random(k)
    for n in (1, 2, 7, 30):
        sizes = [rng.choice((1, 2, 3, 50, 8)) for _ in range(n)]
        prefix = [sum(sizes[:i]) for i in range(n + 1)]
        df = spark.createDataFrame([(prefix,)], "p array<long>").withColumn("c", H.smallest_capacity(F.col("p"), k))
        row = df.withColumn("cuts", H.cut_positions(F.col("p"), F.col("c"), k)).first()
        assert row.c == brute_capacity(sizes, k)
        edges = [0, *row.cuts, n]
        assert len(row.cuts) == k - 1 and edges == sorted(edges)
        assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= row.c


def check(rows, texts, k=24):
    assert {r.law for r in rows} <= {"bytes"}
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and 0 <= r.shard < k and r.grown_shard is None
        slots[r.shard].append(r.slot)
        of_text[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return {s: sum(r.size for r in rows if r.shard == s) for s in slots}


def test_corpus(spark, corpus, sf):
    loads = check(H.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect(), corpus)
    assert len(loads) == 24


def test_a_group_of_a_third_of_all_rows(spark):
    texts = {i: "same text " * 20 if i % 3 == 0 else f"{i} text " * (i % 40) for i in range(3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = H.shard_documents(df).collect()
    loads = check(rows, texts)
    group = 1000 * (len("same text " * 20) + 8)
    rest = [v for v in loads.values() if v < group]
    assert max(loads.values()) <= max(group * 1.02, sum(loads.values()) / 24 * 1.1)
    assert max(rest) < 2 * min(rest)


def test_odd_rows(spark, odd, none):
    texts = {r.doc_id: r.text for r in odd.filter("doc_id is not null").collect()}
    rows = H.shard_documents(odd).collect()
    assert len(rows) == 13
    twice = [r for r in rows if r.doc_id == 2]
    assert twice[0].shard == twice[1].shard and twice[0].slot != twice[1].slot
    by = {r.doc_id: r.shard for r in rows}
    assert by[3] == by[4] and texts[3] is None
    assert H.shard_documents(none).collect() == []


def loads_by_group(texts, overhead=8):
    """Sizes of the groups of equal texts in the order of their hash."""
    sizes = defaultdict(int)
    for t in texts:
        data = (t or "").encode()
        sizes[hashlib.md5(data).hexdigest()] += len(data) + overhead
    return [sizes[h] for h in sorted(sizes)]


@pytest.mark.parametrize("bits", [4, 12])
def test_the_capacity_is_exact_for_groups(spark, bits):
    """However coarse the first atoms are: with 4 bits, 16 atoms hold hundreds of groups, and two large ones share one."""
    rng = random.Random(bits)
    for shards, n in ((24, 400), (5, 300), (24, 30)):
        texts = ["x" * rng.choice((3, 40, 700)) + str(i) for i in range(n)]
        texts += ["y" * 9000 + str(i) for i in range(3)] + [texts[0]] * 50
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        config = H.ShardConfig(shards=shards, order_bits=bits, refine_bits=4)
        rows = H.shard_documents(df, config).collect()
        load = check(rows, dict(enumerate(texts)), shards)
        groups = loads_by_group(texts)
        least, low = sum(groups), 0
        while least - low > 1:  # the smallest capacity by a greedy pass over the groups
            mid = (least + low) // 2
            used, room = 0, 0
            for size in groups:
                if size > mid:
                    used = shards + 1
                    break
                if size > room:
                    used, room = used + 1, mid
                room -= size
            least, low = (mid, low) if used <= shards else (least, mid)
        assert max(load.values()) <= least
        found = H.settled_atoms(H.sized(df, config).groupBy("h").agg(F.sum("size").alias("size")), config).first()
        assert found.capacity == least


def test_equal_rows_have_slots_of_their_own(spark):
    rows = [(7, "same")] * 500 + [(i, f"text {i}") for i in range(100)]
    got = H.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), H.ShardConfig(slot_parts=4)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 600 and all(sorted(s) == list(range(len(s))) for s in slots.values())
