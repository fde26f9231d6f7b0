"""Connected components, folds and splits by group, and greedy balanced sampling."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.session import shared_folder

from .ordering import numbered


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, component: the smallest key that is connected to each node.

    edges: key, link (nodes that share a link are connected). The smallest label of a link goes to its nodes and the
    smallest of a node to its links; a node then also takes its label's label, so the rounds grow with the logarithm of
    a component's width. Each round is a checkpoint in the cluster's shared folder."""
    labels = nodes.select(key, F.col(key).alias("component"))
    shared_folder(nodes.sparkSession)
    while True:
        by_link = edges.join(labels, key).groupBy("link").agg(F.min("component").alias("least"))
        heard = edges.join(by_link, "link").groupBy(key).agg(F.min("least").alias("heard"))
        near = labels.join(heard, key, "left").withColumn("new", F.least("component", F.coalesce("heard", "component")))
        # The label is a node too: take what it has come to.
        far = near.select(F.col(key).alias("component_key"), F.col("new").alias("jump"))
        moved = near.join(far, near["new"] == far["component_key"], "left").select(
            key, "component", F.least("new", F.coalesce("jump", "new")).alias("next")
        ).checkpoint()
        if moved.filter("next <> component").isEmpty():
            return moved.select(key, F.col("next").alias("component"))
        labels = moved.select(key, F.col("next").alias("component"))


def group_folds(groups: DataFrame, group: str, n: int) -> DataFrame:
    """group, fold: groups by descending size (ties by name) are dealt in turn; no group is in two folds."""
    sized = groups.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    placed = numbered(sized, "place", "size", descending=True, ties=[group])
    return placed.select(group, "size", (F.col("place") % n).cast("int").alias("fold"))


def fold_manifest(rows: DataFrame, folds: DataFrame, group: str, y: str) -> DataFrame:
    """fold, rows, positives, groups, overlap: how many groups are also in another fold (0 by construction)."""
    joined = rows.join(folds.select(group, "fold"), group)
    spread = joined.groupBy(group).agg(F.countDistinct("fold").alias("n"))
    return (
        joined.join(spread, group)
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(y).alias("positives"),
            F.countDistinct(group).alias("groups"),
            F.countDistinct(F.when(F.col("n") > 1, F.col(group))).alias("overlap"),
        )
    )


#: Kinds of components that are placed by search, and up to which pairs of moves are tried.
MOST_KINDS, MOST_PAIRED = 256, 24


def allocate(
    vectors: list[tuple[tuple[int, ...], int]], ratios: dict[str, float], placed: dict[tuple[str, int], int] | None = None
) -> dict[tuple[int, ...], dict[str, int]]:
    """How many components of each kind go to each split, so that the largest relative deviation of any total from its
    target is least, then the sum of deviations.

    vectors: (sizes of a kind, how many components), as equal components are interchangeable; placed: what (split, measure)
    already holds. Counts are rounded shares at first; then single moves between splits, and pairs of them where kinds are
    few, improve the pair of objectives until none does."""
    placed = placed or {}
    names = list(ratios)
    width = len(vectors[0][0])
    totals = [sum(v[m] * n for v, n in vectors) + sum(placed.get((s, m), 0) for s in names) for m in range(width)]
    targets = {(s, m): ratios[s] * totals[m] for s in names for m in range(width)}

    def score(plan: dict) -> tuple[float, float]:
        off = [
            abs(sum(v[m] * plan[v][s] for v, _ in vectors) + placed.get((s, m), 0) - targets[s, m]) / targets[s, m]
            for s in names
            for m in range(width)
            if targets[s, m]
        ]
        return (round(max(off), 12), round(sum(off), 12)) if off else (0.0, 0.0)

    plan = {}
    for v, n in vectors:
        counts = {s: int(ratios[s] * n) for s in names}
        for s in sorted(names, key=lambda s: ratios[s] * n - counts[s], reverse=True)[: n - sum(counts.values())]:
            counts[s] += 1
        plan[v] = counts
    best = score(plan)
    while True:
        found = None
        moves = [((v, a, b),) for v, _ in vectors for a, b in product(names, names) if a != b]
        pairs = [(x[0], y[0]) for x in moves for y in moves if x < y] if len(vectors) <= MOST_PAIRED else []
        for move in moves + pairs:
            if any(plan[v][a] < sum(1 for w in move if w[0] == v and w[1] == a) for v, a, _ in move):
                continue
            for v, a, b in move:
                plan[v][a] -= 1
                plan[v][b] += 1
            now = score(plan)
            if now < (found[0] if found else best):
                found = (now, move)
            for v, a, b in move:
                plan[v][a] += 1
                plan[v][b] -= 1
        if not found:
            return plan
        best = found[0]
        for v, a, b in found[1]:
            plan[v][a] -= 1
            plan[v][b] += 1


def split_components(parts: DataFrame, component: str, measures: list[str], ratios: dict[str, float], seed: str) -> DataFrame:
    """component, split. parts: component and its measures.

    The MOST_KINDS kinds (distinct measures) that hold most are placed by allocate(); components of a kind are told apart
    by a hash of the seed and their name. All other components, each a small share, go by that hash, and allocate() makes
    up for what they leave. At most MOST_KINDS rows and a sum per split come to the driver."""
    names = list(ratios)
    weight = F.col("n") * sum((F.col(m).cast("double") for m in measures), F.lit(0.0))
    kinds = parts.groupBy(*measures).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(weight), *measures).limit(MOST_KINDS).collect()
    if not kinds:
        return parts.select(component, F.lit(None).cast("string").alias("split"))
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(component).cast("string")), 256)
    schema = ", ".join(f"{m} long" for m in measures)
    table = parts.sparkSession.createDataFrame([tuple(k[m] for m in measures) for k in kinds], schema)
    small = parts.select(component, *measures).join(F.broadcast(table), measures, "left_anti")
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    split, upto = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        upto -= ratios[names[names.index(name) + 1]]
        split = F.when(drawn < upto, name).otherwise(split)
    small = small.withColumn("split", split)
    held = {}
    for r in small.groupBy("split").agg(*[F.sum(m).alias(m) for m in measures]).collect():
        held |= {(r["split"], i): r[m] for i, m in enumerate(measures)}
    plan = allocate([(tuple(k[m] for m in measures), k["n"]) for k in kinds], ratios, held)
    rows = []
    for kind, counts in plan.items():
        at = 0
        for name, n in counts.items():
            rows.append((*kind, at, at + n, name))
            at += n
    table = parts.sparkSession.createDataFrame(rows, f"{schema}, low long, high long, split string")
    nth = F.row_number().over(Window.partitionBy(*measures).orderBy(digest)) - 1
    placed = parts.select(component, *measures).withColumn("nth", nth)
    large = placed.join(F.broadcast(table), measures).filter("nth >= low and nth < high")
    return large.select(component, "split").unionByName(small.select(component, "split"))


def balanced_sample(candidates: DataFrame, strata: str, per_stratum: int, spread: list[str], key: str, unique: str, seed: str) -> DataFrame:
    """per_stratum rows of each stratum, one per `unique`, chosen by turns: the next row is the one whose values of the
    spread columns were taken least so far, ties by a hash. Taking turns is sequential, so each stratum is one group; the
    pool is first cut to the smallest hashes of each combination of spread values, which holds every row that can win."""
    tagged = candidates.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256))
    one = Window.partitionBy(strata, unique).orderBy("__h")
    pool = Window.partitionBy(strata, *spread).orderBy("__h")
    single = tagged.withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    small = single.withColumn("__n", F.row_number().over(pool)).filter(F.col("__n") <= per_stratum).drop("__n")

    def choose(rows):
        taken = {c: {} for c in spread}
        left, out = rows.sort_values("__h").to_dict("records"), []
        while left and len(out) < per_stratum:
            best = min(left, key=lambda r: (*(taken[c].get(r[c], 0) for c in spread), r["__h"]))
            left.remove(best)
            out.append(best)
            for c in spread:
                taken[c][best[c]] = taken[c].get(best[c], 0) + 1
        return rows.iloc[:0] if not out else type(rows)(out)[list(rows.columns)]

    return small.groupBy(strata).applyInPandas(choose, small.schema).drop("__h")
