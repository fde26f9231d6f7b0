"""MinHash near-dedup: DartMinHash signatures, a banded join, exact verification, connected classes.

Signatures. A document is a set of weighted elements (hashed shingles). Every element throws darts: points of a Poisson
process over (weight, rank), drawn from a hash of the element, so that equal elements throw equal darts anywhere. A dart
below the element's weight is a hit; each hit belongs to one of `bands * rows` coordinates by its hash, and a
coordinate keeps its hit of the smallest rank. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity, the sum of the smaller weights over that of the larger. Ranks are looked at up to a limit at which some k ln k + 2k darts are expected, so the work after one
draw per element is the same for a long document and a short one; a document with a coordinate still empty goes on to
twice the limit. A shingle's weight is its count (`count`; `set` makes all weights 1); verification is by the same weights.

Classes. Documents with equal weighted shingles are one class at once and go on as one node, a 64-bit hash of the set; doc_id
plays no part in who is compared, and a row is known by its doc_id and a hash of its text. Signatures are cut
into bands; those who share a band form a bucket. No bucket is expanded into its pairs: in each round it names one pivot,
the member with most bucket-mates, and the others that aren't in the pivot's class yet are compared with it, exactly, by
their shingle sets; links join classes; the pivot leaves the bucket; buckets of one class are done. What matters is
which class a document is in, so comparisons inside a class are needless, and groups of copies of any size end after a
round or two. After `pivot_rounds`, what is left are documents alike enough to meet but not to be linked. From then on a
round compares up to `leaders` members of a bucket (all of a smaller one) with all others, in parts of bounded size: by
one byte of each coordinate of their signatures first, and pairs that agree in no fewer than five standard deviations
below the similarity by 32 bits of each shingle, in the first of the buckets that they share. The few that pass go on to
the exact comparison. The loop ends when no bucket holds two classes with members not compared; nothing is capped.

Edge cases: a null text is empty; texts without a word are one class; a text of fewer words than a shingle has one
shingle, all its words; rows with a null doc_id are each in the class of their text, are kept where no row of the class
has an id, and have the class_id null; rows that share a doc_id are each in the class of their text; an empty table gives an empty table; extra columns stay in `keep_one` and aren't read by `near_classes`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each, small_batches, staged as staged_anyhow, whole
from .words import U, mixed, run_hashes, word_hashes

SHINGLE = 7
#: Bytes of the rows that go to a worker at once; each is held by the JVM and the worker, there twice while it is read.
BATCH_BYTES = 4 << 20
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class NearConfig:
    shingle_words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    weights: str = "count"
    seed: int = 1
    pivot_rounds: int = 2
    leaders: int = 1024
    #: Members of a bucket that are compared with its leaders in one part.
    part: int = 4096
    #: Elements and darts that a worker holds at once, about; one long document may go beyond.
    most_at_once: int = 200_000

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates that all but one in a million pairs of the least similarity have."""
        k, s = self.coordinates, self.similarity
        return int(k * s - 5 * (k * s * (1 - s)) ** 0.5)


def staged(df: DataFrame, name: str) -> DataFrame:
    with small_batches(df.sparkSession, BATCH_BYTES):
        return staged_anyhow(df, name)


def shingles(text: str | None, config: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, ascending, and how often each occurs."""
    hashes = word_hashes(text)
    length = min(config.shingle_words, len(hashes))
    if not length:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.unique(run_hashes(hashes, length, SHINGLE + length), return_counts=True)


def occurrences(text: str | None, config: NearConfig) -> np.ndarray:
    """Numbers, ascending, whose Jaccard similarity as sets is that of the texts' weighted shingles: one for each shingle,
    with counts as weights one for each of its occurrences."""
    elements, counts = shingles(text, config)
    if config.weights == "set" or not len(counts) or counts.max() == 1:
        return elements
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    each = np.repeat(elements, counts)
    return np.unique(np.where(nth > 0, mixed(each + nth.astype(U) * U(0x9E3779B97F4A7C15)), each))


def _steps(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two constants for each of n arrivals from the first."""
    at = np.arange(3 * first + 3, 3 * (first + n) + 3, 3, dtype=U)
    return at * U(0x9E3779B97F4A7C15), (at + U(1)) * U(0x9E3779B97F4A7C15)


def _uniform(keys: np.ndarray) -> np.ndarray:
    """A number in (0, 1] for each key."""
    return ((keys >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def throw(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, coordinate, rank, dart) of all darts that hit up to each owner's limit of rank.

    The weight axis is cut into layers [0, 1), [1, 2), [2, 4), ...; in a layer of width v, ranks arrive at rate v and
    weights are uniform."""
    hits: list[tuple[np.ndarray, ...]] = []
    low, high, layer = 0.0, 1.0, 0
    now = np.arange(len(elements))
    while len(now):
        key = mixed(elements[now] ^ U(xxhash.xxh64_intdigest(f"{seed}:{layer}".encode())))
        rank, there, m = np.zeros(len(now)), np.arange(len(now)), 0
        while len(there):
            # The m-th arrival of each element depends on m alone; few elements left are taken many steps at once.
            ahead = max(1, min(64, 16_384 // len(there)))
            steps = _steps(m, ahead)
            ranks = rank[:, None] - np.cumsum(np.log(_uniform(mixed(key[there][:, None] + steps[0]))), 1) / (high - low)
            stays = ranks <= limit[owner[now[there]]][:, None]
            dart = mixed((key[there][:, None] + steps[1])[stays])
            which = there[np.nonzero(stays)[0]]
            hit = np.ones(len(dart), bool)
            if high > 1.0 or weights[now[which]].min(initial=1.0) < 1.0:
                hit = low + (high - low) * (1.0 - _uniform(mixed(dart + U(1)))) < weights[now[which]]
            hits.append((owner[now[which[hit]]], (dart[hit] % U(k)).astype(np.int64), ranks[stays][hit], mixed(dart[hit] + U(2))))
            on = stays[:, -1]
            rank, there, m = ranks[on, -1], there[on], m + ahead
        low, high, layer = high, 2.0 * high, layer + 1
        now = now[weights[now] > low]
    return tuple(np.concatenate(x) for x in zip(*hits)) if hits else tuple(np.empty(0, t) for t in (np.int64, np.int64, float, U))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], config: NearConfig) -> np.ndarray:
    """One row of `coordinates` dart hashes per document (0 throughout for documents without shingles)."""
    k = config.coordinates
    out = np.zeros((len(sets), k), U)
    best = np.full((len(sets), k), np.inf)
    full = np.array([len(e) for e, _ in sets]) > 0
    totals = np.array([float(len(e) if config.weights == "set" else c.sum()) for e, c in sets])
    limits = np.where(full, (k * np.log(k) + 2 * k) / np.maximum(totals, 1e-9), 0.0)
    open_ = np.flatnonzero(full)
    while len(open_):
        elements = np.concatenate([sets[i][0] for i in open_])
        counts = np.concatenate([sets[i][1] for i in open_])
        owner = np.repeat(open_, [len(sets[i][0]) for i in open_])
        weights = np.ones(len(elements)) if config.weights == "set" else counts.astype(np.float64)
        who, where, rank, dart = throw(elements, weights, owner, limits, k, config.seed)
        cell = who * k + where
        np.minimum.at(best.reshape(-1), cell, rank)
        first = rank == best.reshape(-1)[cell]
        out.reshape(-1)[cell[first]] = dart[first]
        open_ = open_[~np.isfinite(best[open_]).all(1)]
        limits[open_] *= 2
    return out


def signed(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, t, node (a hash of the weighted shingles), bands (array of hashes, empty without shingles), sig (a byte a
    coordinate).

    docs: doc_id, t, text."""

    def signed_batch(ids: list[tuple[int | None, int]], sets: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        darts = signatures(sets, config)
        rows = darts.reshape(len(sets), config.bands, config.rows)
        bands = np.zeros((len(sets), config.bands), U)
        for r in range(config.rows):
            bands = mixed(bands * U(31) + rows[:, :, r])
        lists = [b if len(e) else b[:0] for b, (e, _) in zip(bands.view(np.int64), sets)]
        weighted = [e if config.weights == "set" else np.concatenate([e, c.astype(U)]) for e, c in sets]
        nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in weighted], U).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(x, pa.int64()) for x in zip(*ids)),
                pa.array(nodes),
                pa.array(lists, pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in darts.astype(np.uint8)], pa.binary()),
            ],
            names=["doc_id", "t", "node", "bands", "sig"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for i, t, text in zip(*(each(batch.column(c)) for c in ("doc_id", "t", "text"))):
                ids.append((i, t))
                sets.append(shingles(text, config))
                size += len(sets[-1][0]) + 1000
                if size > config.most_at_once:
                    yield signed_batch(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield signed_batch(ids, sets)

    return docs.select("doc_id", "t", "text").mapInArrow(sign, "doc_id long, t long, node long, bands array<long>, sig binary")


def similar_pairs(pairs: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """The pairs (a, b) whose weighted shingles have at least the similarity; texts: id, text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.empty(0, U)
        for batch in batches:
            keep = []
            a_of, one_of = batch.column("a").to_numpy(), batch.column("text_a")
            for i, (a, other) in enumerate(zip(a_of, each(batch.column("text_b")))):
                if last is None or last != a:
                    last, mine = a, occurrences(one_of[i].as_py(), config)
                yours = occurrences(other, config)
                if min(len(mine), len(yours)) < config.similarity * max(len(mine), len(yours)):
                    continue
                both = len(np.intersect1d(mine, yours, assume_unique=True))
                if both >= config.similarity * (len(mine) + len(yours) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one, other = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # Joining b first leaves the rows ordered by a, the pivot, whose shingles are then made once a run.
    return pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, for the nodes of edges (a, b).

    Alternates between linking every larger neighbour of a node to its smallest (large star) and every smaller one
    (small star), until nothing changes; each round is a written table, and nodes of any degree are combined before the
    shuffle."""
    edges = staged(edges.filter("a <> b").select("a", "b").distinct(), "near-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(lowest, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = staged(small, "near-edges")
        # Both sums together settle only when the edges do: a star keeps its edges under both steps.
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _rounds(buckets: DataFrame, sigs: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame | None:
    """node, label for the documents that some link joins to another. buckets: key, id, band, mates; sigs: id, sig, bands, shingles."""
    columns = ["key", "id", "band", "mates"]
    labels, links, n = None, None, 0
    while True:
        n += 1
        classed = (
            buckets.withColumn("label", F.col("id"))
            if labels is None
            else buckets.join(labels, buckets.id == labels.node, "left")
            .withColumn("label", F.coalesce("label", "id"))
            .drop("node")
        )
        state = classed.groupBy("key").agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.count(F.lit(1)).alias("members"),
            F.max_by(F.struct("id", "label"), F.struct("mates", F.bitwise_not("id"))).alias("pivot"),
        )
        alive = classed.join(state.filter("low < high").drop("low", "high"), "key")
        if n > config.pivot_rounds:
            nth = F.pmod(F.xxhash64("key", "id", F.lit(n)), F.col("members"))
            alive = alive.withColumn("leads", nth < config.leaders)
            pairs = _against_leaders(alive.join(sigs, "id"), config)
            left = alive.filter("not leads").select(*columns)
        else:
            pairs, left = _against_pivot(alive), _without_pivot(alive).select(*columns)
        pairs = staged(pairs.distinct(), "near-pairs")
        if pairs.isEmpty() and (n <= config.pivot_rounds or left.isEmpty()):
            return labels
        found = staged(similar_pairs(pairs, texts, config), "near-links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = staged(components(links), "near-labels")
        buckets = staged(left, "near-buckets")


def _against_pivot(alive: DataFrame) -> DataFrame:
    return alive.filter(F.col("label") != F.col("pivot.label")).select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))


def shingle_bytes(texts: DataFrame, config: NearConfig) -> DataFrame:
    """id, shingles: 32 bits of each of the text's occurrences(), ascending. texts: id, text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(occurrences(t, config).astype(np.uint32)) for t in each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"]
            )

    return texts.select("id", "text").mapInArrow(find, "id long, shingles binary")


def _against_leaders(alive: DataFrame, config: NearConfig) -> DataFrame:
    """Pairs of a leader and a member of its bucket, of different classes, that are alike by 32 bits of each shingle.

    A large bucket is dealt into parts that each get all its leaders; a worker holds the leaders of one part."""
    parts = F.ceil(F.col("members") / config.part).cast("int")
    columns = ["key", "part", "leads", "id", "label", "band", "sig", "bands", "shingles"]
    members = alive.withColumns({"part": F.pmod(F.xxhash64("id"), parts).cast("int"), "leads": F.lit(False)})
    leaders = alive.filter("leads").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = members.select(*columns).unionByName(leaders.select(*columns)).repartition("key", "part")
    least, k = config.least_equal, config.coordinates

    def alike(mine: bytes, yours: bytes) -> bool:
        a, b = np.frombuffer(mine, np.uint32), np.frombuffer(yours, np.uint32)
        if min(len(a), len(b)) < 0.99 * config.similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        # A hundredth of slack for shingles that share their 32 bits.
        return both >= 0.99 * config.similarity * (len(a) + len(b) - both)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead_ids, lead_of = None, np.empty(0, np.int64), np.empty(0, np.int64)
        lead_sigs, lead_bands, lead_sets = np.empty((0, k), np.uint8), np.empty((0, config.bands), np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, leads, who, of, band = (batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:6])
            sets = batch.column("shingles").to_pylist()
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, k)
            bands = np.array(batch.column("bands").to_pylist(), np.int64)
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            out: list[tuple[int, int]] = []
            for start, end in zip([0, *edges], [*edges, len(key)]):
                if group != (key[start], part[start]):
                    group, lead_sets = (key[start], part[start]), []
                    lead_ids, lead_of, lead_sigs, lead_bands = lead_ids[:0], lead_of[:0], lead_sigs[:0], lead_bands[:0]
                head = start + int(leads[start:end].sum())
                if head > start:
                    lead_ids, lead_of = np.concatenate([lead_ids, who[start:head]]), np.concatenate([lead_of, of[start:head]])
                    lead_sigs = np.concatenate([lead_sigs, sigs[start:head]])
                    lead_bands = np.concatenate([lead_bands, bands[start:head]])
                    lead_sets += sets[start:head]
                step = max(1, 20_000_000 // (k * max(1, len(lead_ids))))
                for i in range(head, end, step):
                    j = min(end, i + step)
                    near = (sigs[i:j, None, :] == lead_sigs[None, :, :]).sum(2) >= least
                    member, leader = np.nonzero(near & (of[i:j, None] != lead_of[None, :]))
                    before = band[start]
                    earlier = (bands[i + member, :before] == lead_bands[leader, :before]).any(1)
                    for m, x in zip((i + member)[~earlier], leader[~earlier]):
                        if alike(sets[m], lead_sets[x]):
                            out.append((int(min(who[m], lead_ids[x])), int(max(who[m], lead_ids[x]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
            )

    return dealt.sortWithinPartitions("key", "part", F.desc("leads")).mapInArrow(compare, "a long, b long")


def _without_pivot(alive: DataFrame) -> DataFrame:
    return alive.filter(F.col("id") != F.col("pivot.id"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id as a number, t (a hash of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _classed(docs: DataFrame, config: NearConfig) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Signatures by row; nodes with their heads, which are a node's first row by (no doc_id, doc_id, t); labels."""
    rows = keyed(docs)
    sigs = staged(signed(rows, config), "near-signatures")
    head = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t")
    sets = sigs.groupBy("node").agg(F.min(head).alias("head"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    banded = sets.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "hash")).select(
        F.xxhash64("band", "hash").alias("key"), "id", "band"
    )
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    joined = staged(banded.join(shared, "key"), "near-banded")
    mates = joined.groupBy("id").agg(F.sum("members").alias("mates"))
    buckets = joined.join(mates, "id").select("key", "id", "band", "mates")
    known = F.coalesce("doc_id", F.lit(NO_ID)).alias("known")
    heads = sigs.groupBy("node").agg(F.min(head).alias("head"))
    wanted = heads.select(F.col("node").alias("id"), "head.*").join(mates.select("id"), "id", "left_semi").select(known, "t", "id")
    texts = rows.select(known, "t", "text").join(wanted, ["known", "t"]).dropDuplicates(["known", "t"]).select("id", "text")
    texts = staged(texts, "near-texts")
    compact = sets.select(F.col("node").alias("id"), "sig", "bands").join(shingle_bytes(texts, config), "id")
    return sigs, heads, _rounds(staged(buckets, "near-buckets"), staged(compact, "near-bytes"), texts, config)


def near_classes(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, class_id: one row per row of docs; class_id is the smallest doc_id of the class, null where doc_id is."""
    sigs, heads, labels = _classed(docs, config)
    least = heads.select("node", F.col("head.doc_id").alias("class_id"))
    if labels is not None:
        linked = least.join(labels, "node")
        linked = linked.join(linked.groupBy("label").agg(F.min("class_id").alias("first")), "label").select("node", "first")
        least = least.join(linked, "node", "left").select("node", F.coalesce("first", "class_id").alias("class_id"))
    return sigs.select("doc_id", "node").join(least, "node").select("doc_id", F.expr("if(doc_id is null, null, class_id)").alias("class_id"))


def keep_one(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row of each class with its own columns: that of the smallest doc_id, one without a doc_id if none has any."""
    _, heads, labels = _classed(docs, config)
    if labels is not None:
        label = F.coalesce("label", "node")
        heads = heads.join(labels, "node", "left").groupBy(label).agg(F.min("head").alias("head"))
    kept = heads.select(F.col("head.doc_id").alias("id"), F.col("head.t").alias("kept_t"))
    rows = docs.select(whole(docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"))
    # Rows of equal doc_id and text are alike but for further columns.
    first = Window.partitionBy("doc", "t").orderBy("t")
    return (
        rows.join(kept, F.col("doc").eqNullSafe(F.col("id")) & (F.col("t") == F.col("kept_t")), "left_semi")
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .select("row.*")
    )
