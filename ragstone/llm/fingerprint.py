"""Document fingerprints: a threshold-scaled sketch (FracMinHash) over five-word shingles.

Every shingle hash (63 bits) below 2 ** 63 / scale is kept; where none is, the smallest hash of the text stands in, so
that no text with a word has an empty sketch. Sketches merge exactly: `merged` of two sketches is the sketch of both
shingle sets, as a stand-in gives way to kept hashes or to a smaller stand-in. The containment of one text in another is
estimated as the share of its kept hashes that the other keeps too, however unequal the two are. Texts with fewer than
five words have one shingle, all their words.

`compare_with_next` joins every document to the next one in descending order of doc_id (after the last: the first)
without a global sort in one task: approximate quantiles of doc_id, which are ids themselves, cut the order into
buckets of about `bucket_rows` rows, and the first row of each bucket also goes, as a guest, to the bucket before.

Edge cases: a null text is empty; texts without words have empty sketches, whose likeness is 1 to each other and 0 to
any other; null ids come last; rows with one id follow each other in order of their text; a lone row follows itself; an
empty table gives an empty table; further columns of the input aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_at_most, let, longs, text_of, words_of

LARGEST = (1 << 63) - 1
#: Where null ids stand.
LEAST_ID = -(1 << 63)


@dataclass(frozen=True)
class SketchConfig:
    shingle_words: int = 5
    scale: int = 8
    bucket_rows: int = 1024
    max_buckets: int = 100_000


def shingle_hashes(text: Column, config: SketchConfig = SketchConfig()) -> Column:
    k = config.shingle_words

    def of(words: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        )
        return (
            F.when(F.size(words) >= k, each)
            .when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words_of(text), of)


def _kept(ordered: Column, config: SketchConfig) -> Column:
    """Of ascending hashes, those below the threshold, or else the smallest."""
    low = F.filter(ordered, lambda h: h <= F.lit(LARGEST // config.scale))
    return let(low, lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice(ordered, 1, 1)))


def sketch(text: Column, config: SketchConfig = SketchConfig()) -> Column:
    """The kept hashes, ascending."""

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h <= F.lit(LARGEST // config.scale))
        return let(
            low,
            lambda x: F.when(F.size(x) > 0, F.sort_array(F.array_distinct(x))).otherwise(
                F.array_compact(F.array(F.array_min(hashes)))
            ),
        )

    positive = F.transform(shingle_hashes(text, config), lambda h: h.bitwiseAND(F.lit(LARGEST)))
    return let(positive, kept)


def merged(a: Column, b: Column, config: SketchConfig = SketchConfig()) -> Column:
    """The sketch of the shingles of two texts taken together."""
    return let(F.sort_array(F.array_union(a, b)), lambda both: _kept(both, config))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a).cast("double")
    )


def likeness(a: Column, b: Column) -> Column:
    """The containment of the smaller sketch in the larger."""
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.when(F.size(small) == 0, (F.size(large) == 0).cast("double")).otherwise(containment(small, large))


def printed(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def with_next(rows: DataFrame, columns: list[str], config: SketchConfig = SketchConfig()) -> DataFrame:
    """rows (doc_id and columns) with `next`, a struct of the next row's columns, in descending order of doc_id."""
    keyed = rows.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)))
    ids = keyed.select("id")
    n = ids.count()
    if n == 0:
        return keyed.drop("id").withColumn("next", F.struct(*columns))
    buckets = max(1, min(config.max_buckets, -(-n // config.bucket_rows)))
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)]) if buckets > 1 else None
    asked = [F.max("id").alias("most")]
    if buckets > 1:
        asked.append(F.percentile_approx("id", steps, F.lit(min(1_000_000, 20 * buckets + 10_000))).alias("cuts"))
    got = ids.agg(*asked).first()
    # Ascending; bucket b holds the ids in (firsts[b - 1], firsts[b]] and starts, in descending order, with firsts[b].
    firsts = sorted({got["most"], *(got["cuts"] if buckets > 1 else [])})
    bounds = longs(firsts)
    own = keyed.withColumns({"bucket": count_at_most(bounds, F.col("id") - 1, bits=20), "guest": F.lit(False)})
    if LEAST_ID in firsts:  # id - 1 would wrap around
        own = own.withColumn("bucket", F.when(F.col("id") == LEAST_ID, 0).otherwise(F.col("bucket")))
    place = count_at_most(bounds, F.col("id"), bits=20) - 1
    guests = (
        keyed.filter(F.array_contains(bounds, F.col("id")))
        .withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*columns)))
        .filter("nth = 1")
        .drop("nth")
        .withColumns({"bucket": (place + 1) % len(firsts), "guest": F.lit(True)})
    )
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), *columns)
    return (
        own.unionByName(guests)
        .withColumn("next", F.lead(F.struct(*columns)).over(order))
        .filter(~F.col("guest"))
        .drop("guest", "bucket", "id")
    )


def compare_with_next(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("sketch", sketch(F.col("text"), config))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    return (
        with_next(rows, ["text", "sketch"], config)
        .select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("other"), edited.alias("edited"))
        .withColumn("edited_sketch", sketch(F.col("edited"), config))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            printed(F.col("sketch")).alias("fingerprint"),
            printed(F.col("edited_sketch")).alias("edited_fingerprint"),
            likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
            likeness(F.col("sketch"), F.col("other")).alias("near_next"),
        )
    )
