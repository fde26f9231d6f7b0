"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts form a group and stay together. Groups are ordered by the MD5 of their text. The search runs
over atoms, runs of that order with a common prefix of the hash, whose sizes are prefix sums in one row:

  * a binary search finds the smallest capacity for which a greedy pass needs no more than `shards` shards, once with
    atoms as they are and once with every atom of several groups cut freely, which no partition of groups can beat;
  * as long as the two differ, the atoms that the second pass cuts are refined, into single groups if they hold at most
    2 ** `refine_bits` and by so many more bits of the hash otherwise. When they agree, the capacity is the smallest for
    groups. A round refines fewer atoms than there are shards, so the row stays short whatever the number of groups;
  * the cuts are made: atoms beyond an equal share stand alone, and what lies between them is cut into equal parts, each
    as near as the capacity allows, between the earliest position from which the rest still fits and the latest that the
    shards so far can reach.

Slots are numbered without gathering a shard in one task: equal rows are counted first, the counts dealt into
`slot_parts` parts by a hash, summed inside (shard, part), and shifted by the counts of the parts before, a table of
shards x parts rows.

Edge cases: a null text counts as empty (size `overhead`, CRC 0) and belongs to the group of empty texts; repeated rows
are in one shard in slots of their own; null ids are allowed; an empty table gives an empty table; a group larger than
an equal share gets a shard as large as itself; further columns of the input aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_at_most, let, staged, text_of

#: Hexadecimal digits of the hash that orders groups.
DIGITS = 32


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 24
    overhead: int = 8
    #: Atoms at first, and groups or atoms that one atom is refined into at most, as powers of 2 (multiples of 4).
    order_bits: int = 12
    refine_bits: int = 12
    slot_parts: int = 1024


def sized(docs: DataFrame, config: ShardConfig) -> DataFrame:
    """doc_id, size, text_crc32, h (what groups are ordered by): one scan, no text is kept."""
    text = text_of()
    return docs.select(
        "doc_id", (F.octet_length(text) + config.overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h")
    )


def reach(prefix: Column, limit: Column) -> Column:
    """The last position whose prefix sum is <= limit (prefix starts with 0, so positions count atoms)."""
    return count_at_most(prefix, limit) - 1


def greedy_ends(prefix: Column, single: Column, capacity: Column, shards: int) -> Column:
    """Where a greedy pass with this capacity ends each shard, as sums of sizes from 0 on; atoms that aren't single may be
    cut anywhere."""

    def end(at: Column) -> Column:
        limit = at + capacity
        return let(
            reach(prefix, limit),
            # The atom after the position is the one that the limit falls into.
            lambda i: F.when(F.coalesce(F.get(single, i), F.lit(True)), F.get(prefix, i)).otherwise(limit),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)),
        F.array(F.lit(0).cast("long")),
        lambda found, _: F.concat(found, F.array(end(F.element_at(found, -1)))),
    )


def fits(prefix: Column, single: Column, capacity: Column, shards: int) -> Column:
    """Whether a greedy pass with this capacity gets to the end."""
    return F.element_at(greedy_ends(prefix, single, capacity, shards), -1) >= F.element_at(prefix, -1)


def smallest_capacity(prefix: Column, shards: int, single: Column | None = None) -> Column:
    """The smallest capacity that fits; without `single`, no atom is cut."""
    total = F.element_at(prefix, -1)
    single = F.array_repeat(F.lit(True), F.size(prefix) - 1) if single is None else single
    searched = let(
        single,
        lambda one: F.aggregate(
            F.sequence(F.lit(1), F.lit(63)),
            F.struct(F.lit(0).cast("long").alias("no"), total.cast("long").alias("yes")),
            lambda s, _: F.when(s["yes"] - s["no"] <= 1, s).otherwise(
                let(
                    s["no"] + F.floor((s["yes"] - s["no"]) / 2).cast("long"),
                    lambda mid: F.when(fits(prefix, one, mid, shards), F.struct(s["no"].alias("no"), mid.alias("yes"))).otherwise(
                        F.struct(mid.alias("no"), s["yes"].alias("yes"))
                    ),
                )
            ),
        ),
    )
    return searched["yes"]


def beyond_share(prefix: Column, shards: int) -> Column:
    """(at, size) of the atoms, counted from 1, that are larger than an equal share of all the others; under `shards`."""
    atoms = F.transform(
        F.sequence(F.lit(1), F.size(prefix) - 1),
        lambda i: F.struct(i.alias("at"), (F.get(prefix, i) - F.get(prefix, i - 1)).alias("size")),
    )
    total = F.element_at(prefix, -1)

    def again(found: Column, every: Column) -> Column:
        alone = F.aggregate(found, F.lit(0).cast("long"), lambda s, a: s + a["size"])
        share = (total - alone) / F.greatest(F.lit(1), shards - F.size(found))
        return F.filter(every, lambda a: a["size"] > share)

    # The share falls as large atoms leave it; a few rounds settle which ones do.
    return let(
        atoms,
        lambda every: F.aggregate(
            F.sequence(F.lit(1), F.lit(8)),
            F.filter(every, lambda a: a["size"] * shards > total),
            lambda found, _: F.when(F.size(again(found, every)) < shards, again(found, every)).otherwise(found),
        ),
    )


def cut_positions(prefix: Column, capacity: Column, shards: int) -> Column:
    """shards - 1 positions, ascending: the atoms before the first position are shard 0, and so on."""
    last = F.size(prefix) - 1
    total = F.element_at(prefix, -1)
    # earliest[j]: the first position from which shards - j shards still hold the rest (from the right, greedily).
    earliest = F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)),
        F.array(last),
        lambda found, _: F.concat(
            F.array(
                let(
                    F.get(prefix, F.get(found, F.lit(0))) - capacity,
                    lambda least: F.when(least <= 0, F.lit(0)).otherwise(count_at_most(prefix, least - 1)),
                )
            ),
            found,
        ),
    )

    def next_cut(found: Column, j: Column, least: Column, giants: Column) -> Column:
        at = F.element_at(found, -1)
        ahead = F.filter(giants, lambda g: g["at"] > at)
        wall = F.coalesce(F.get(ahead, F.lit(0))["at"] - 1, last)
        alone = F.aggregate(ahead, F.lit(0).cast("long"), lambda s, g: s + g["size"])
        share = (total - F.get(prefix, at) - alone) / F.greatest(F.lit(1), shards - j + 1 - F.size(ahead))
        run = F.get(prefix, wall) - F.get(prefix, at)
        part = run / F.greatest(F.lit(1), F.round(run / F.greatest(share, F.lit(1.0))).cast("int"))
        goal = F.get(prefix, at) + part
        below = reach(prefix, F.floor(goal).cast("long"))
        above = F.least(below + 1, wall)
        near = F.when(goal - F.get(prefix, below) <= F.get(prefix, above) - goal, below).otherwise(above)
        wanted = F.when(wall == at, at + 1).otherwise(near)
        most = reach(prefix, F.get(prefix, at) + capacity)
        return F.least(F.greatest(wanted, F.get(least, j)), most)

    cuts = let(
        F.struct(earliest.alias("least"), beyond_share(prefix, shards).alias("giants")),
        lambda known: F.aggregate(
            F.sequence(F.lit(1), F.lit(shards - 1)),
            F.array(F.lit(0)),
            lambda found, j: F.concat(found, F.array(next_cut(found, j, known["least"], known["giants"]))),
        ),
    )
    return F.slice(cuts, 2, shards - 1)


def atoms_of(groups: DataFrame, digits: int | Column) -> DataFrame:
    """atom (the first digits of the hash), size, members (how many groups)."""
    prefix = F.substring(F.col("h"), F.lit(1), digits if isinstance(digits, Column) else F.lit(digits))
    return groups.groupBy(prefix.alias("atom")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"))


def in_one_row(atoms: DataFrame) -> DataFrame:
    """names, prefix (sums of sizes, from 0), single: the atoms in their order."""
    summed = atoms.withColumn("upto", F.sum("size").over(Window.orderBy("atom").rowsBetween(Window.unboundedPreceding, 0)))
    packed = summed.agg(F.sort_array(F.collect_list(F.struct("atom", "upto", "members"))).alias("all"))
    return packed.select(
        F.col("all.atom").alias("names"),
        F.concat(F.array(F.lit(0).cast("long")), F.col("all.upto")).alias("prefix"),
        F.transform("all", lambda a: a["members"] == 1).alias("single"),
    )


def settled_atoms(groups: DataFrame, config: ShardConfig) -> DataFrame:
    """Atoms over which the smallest capacity is that over groups, in one row with it. groups: h, size; one row a group."""
    atoms = staged(atoms_of(groups, config.order_bits // 4), "shard-atoms")
    while True:
        row = in_one_row(atoms)
        found = (
            row.withColumn("capacity", smallest_capacity(F.col("prefix"), config.shards))
            .withColumn("least", smallest_capacity(F.col("prefix"), config.shards, F.col("single")))
            .withColumn("ends", greedy_ends(F.col("prefix"), F.col("single"), F.col("least"), config.shards))
            .select(
                "capacity",
                "least",
                # Atoms that an end lies inside: what ends at a sum that no atom does.
                F.transform(
                    F.filter("ends", lambda e: F.get("prefix", reach(F.col("prefix"), e)) < e),
                    lambda e: F.get("names", reach(F.col("prefix"), e)),
                ).alias("torn"),
            )
            .first()
        )
        torn = sorted({x for x in found["torn"] or [] if x is not None})
        if found["capacity"] is None or found["capacity"] <= found["least"] or not torn:
            return row.withColumn("capacity", F.lit(found["capacity"]).cast("long"))
        known = F.col("atom").isin(torn)
        members = {r["atom"]: r["members"] for r in atoms.filter(known).collect()}
        digits = F.coalesce(
            *[
                F.when(F.startswith("h", F.lit(x)), DIGITS if members[x] <= 1 << config.refine_bits else len(x) + config.refine_bits // 4)
                for x in torn
            ]
        )
        finer = atoms_of(groups.withColumn("digits", digits).filter("digits is not null"), F.col("digits"))
        atoms = staged(atoms.filter(~known).unionByName(finer), "shard-atoms")


def cut_hashes(groups: DataFrame, config: ShardConfig = ShardConfig()) -> list[str]:
    """Prefixes of the hashes at which shards 1, 2, ... start: shards - 1 strings, all that comes to the driver at last."""
    if config.shards == 1:
        return []
    found = (
        settled_atoms(groups, config)
        .withColumn("cuts", cut_positions(F.col("prefix"), F.col("capacity"), config.shards))
        # "g" comes after every hexadecimal digit.
        .select(F.transform("cuts", lambda c: F.coalesce(F.get("names", c), F.lit("g"))).alias("x"))
        .first()
    )
    return list(found["x"])


def shard_documents(docs: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = sized(docs, config)
    groups = staged(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    shard = F.lit(0)
    for cut in cut_hashes(groups, config):
        shard = shard + (F.col("h") >= F.lit(cut)).cast("int")
    names = ["doc_id", "size", "text_crc32", "shard"]
    equal = rows.withColumn("shard", shard).groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    dealt = equal.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(config.slot_parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(starts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("within") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
