import random
import re
from collections import Counter, defaultdict

import pytest

from ragstone.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing by rounds, as the rule is told: cap what is above, share the excess again among the rest."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and left * weight[s] / rest > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        full |= new


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix_report(df).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    source = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    copies = Counter(r.doc_id for r in M.mix_sources(df).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got if r.size)
    assert M.mix_report(df.repartition(7)).collect() and sorted(map(tuple, M.mix_report(df.repartition(7)).collect())) == sorted(map(tuple, got))
    return taken, want


def test_targets_are_met(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for s, n in ((None, 900), ("a", 60), ("b", 900), ("B", 5), ("é", 1500), ("zz", 300)):
        for _ in range(n):
            rows.append((i, s, "w " * rng.randint(1, 40)))
            i += 1
    taken, want = check(spark, rows)
    for s in want:
        assert abs(taken[s] - want[s]) < 0.1 * want[s] + 200


def test_rates_beyond_the_bound_are_joined_by_source(spark):
    rows = [(i, f"s{i % 5}" if i % 5 else None, "w " * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    both = [sorted(map(tuple, M.mix_report(df, M.MixConfig(broadcast_sources=n)).collect())) for n in (0, 100)]
    assert both[0] == both[1]


def test_one_source_and_capped_ones(spark):
    taken, want = check(spark, [(1, "a", "x y z"), (2, "a", "q")])
    assert want == {"a": 4} and taken["a"] == 4
    check(spark, [(1, "a", "x"), (2, "b", "w " * 5000), (3, "c", "y y")])
    check(spark, [(1, None, None), (2, "b", "w w w"), (3, "c", "")])


def test_odd_rows(spark, odd, none):
    rows = M.mix_report(odd).collect()
    assert len(rows) == 13 and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    mixed = M.mix_sources(odd)
    assert mixed.columns == odd.columns
    repeats = [r for r in rows if r.doc_id == 2]
    assert len(repeats) == 2 and repeats[0] == repeats[1]
    assert M.mix_report(none).collect() == [] and M.mix_sources(none).collect() == []


def test_documents_without_an_id_meet_their_target(spark):
    rows = [(None, "nobody", f"{i} " + "w " * (i % 30)) for i in range(2000)] + [(i, "x", "w " * 12) for i in range(4000)]
    got = M.mix_report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    mine = [r for r in got if r.doc_id is None]
    assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.1 * mine[0].target and 0 < mine[0].target % mine[0].source_size


def test_many_sources_are_ranked_in_order(spark):
    names = sorted({f"s{i * 7919 % 5000:x}é" for i in range(3000)}) + [None]
    df = spark.createDataFrame([(n,) for n in sorted(names, key=hash)], "source string").repartition(6)
    got = {r["source"]: r["rank"] for r in M.ranked(df).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 5, "r", 0.5)], "doc_id long, source string, text string, size int, row string, draw double")
    assert [tuple(r) for r in M.mix_sources(docs).collect()] == [(1, "a", "x y", 5, "r", 0.5)]
