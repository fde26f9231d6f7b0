"""Chunking, evidence spans, interval algebra and sufficiency labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.text import collapsed, mapped_text

#: Characters of the needles that are looked for in one pass.
BLOCK_CHARS = 1 << 25


def word_chunks(docs: DataFrame, key: str, window: int = 360, step: int = 280) -> DataFrame:
    """key, chunk_index, n_words, chunk: windows of words, the last one ends with the text."""
    words = docs.select(key, F.split(collapsed(F.col("text")), " ").alias("w")).filter("w[0] <> ''")
    return (
        words.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step))))
        .filter((F.col("start") == 0) | (F.col("start") + window - step < F.size("w")))
        .select(
            key,
            (F.col("start") / step).cast("int").alias("chunk_index"),
            F.slice("w", F.col("start") + 1, F.lit(window)).alias("part"),
        )
        .select(key, "chunk_index", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk"))
    )


def offset_chunks(docs: DataFrame, key: str, window: int = 224, step: int = 176) -> DataFrame:
    """key, chunk_index, char_start, char_end, chunk: windows of tokens with offsets; chunk = text[start:end].

    Stops with the window that reaches the end; texts without tokens have no chunk. The text is cut into blocks of `step`
    tokens in one pass, so offsets are sums over blocks, not over tokens; windows overlap by less than a block."""
    overlap = window - step
    if not 0 <= overlap <= step:
        raise ValueError("windows must overlap by no more than a step")
    tokens_upto = lambda n: rf"(?:\s*+\S++){{1,{n}}}+"
    blocks = docs.select(key, F.regexp_extract_all("text", F.lit(tokens_upto(step)), F.lit(0)).alias("blocks"))
    size = F.size("blocks")
    total = (size - 1) * step + F.regexp_count(F.element_at("blocks", -1), F.lit(r"\S+"))
    last = F.greatest(F.lit(0), F.ceil((total - window) / step).cast("int"))
    upto = F.aggregate(
        F.transform("blocks", lambda b: F.length(b)),
        F.array(F.lit(0)),
        lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)),
    )
    after = F.coalesce(F.length(F.regexp_extract(F.get("blocks", F.col("i") + 1), tokens_upto(overlap), 0)), F.lit(0)) if overlap else F.lit(0)
    lead = F.length(F.regexp_extract(F.get("blocks", "i"), r"^\s*", 0))
    return (
        blocks.filter(size > 0)
        .withColumns({"upto": upto, "i": F.explode(F.sequence(F.lit(0), last))})
        .select(
            key,
            F.col("i").alias("chunk_index"),
            (F.get("upto", "i") + lead).alias("char_start"),
            (F.get("upto", F.col("i") + 1) + after).alias("char_end"),
            F.substring(
                F.array_join(F.slice("blocks", F.col("i") + 1, F.lit(2)), ""),
                lead + 1,
                F.get("upto", F.col("i") + 1) + after - F.get("upto", "i") - lead,
            ).alias("chunk"),
        )
    )


def model_chunks(docs: DataFrame, key: str, offsets: Callable[[], Callable[[str], list[tuple[int, int]]]], window: int = 224, step: int = 176) -> DataFrame:
    """offset_chunks() for a model's tokens: offsets() gives, on the worker, a function from a text to where each of its
    tokens starts and ends. The last window ends with the text; a text without tokens has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = offsets()
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                at = places(text) if text else []
                for i, first in enumerate(range(0, max(1, len(at) - window + step) if at else 0, step)):
                    start, end = at[first][0], at[min(first + window, len(at)) - 1][1]
                    rows.append((name, i, start, end, text[start:end]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[key, "chunk_index", "char_start", "char_end", "chunk"])

    return docs.select(key, "text").mapInArrow(cut, f"{key} {dict(docs.dtypes)[key]}, chunk_index int, char_start int, char_end int, chunk string")


def _needle_blocks(needles: DataFrame) -> list[pa.Table]:
    """item_id, needle: the needles in blocks of about BLOCK_CHARS characters, by a hash of their id."""
    asked = needles.select("item_id", F.col("text").alias("needle")).filter("needle <> ''")
    chars = asked.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    return [asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow() for i in range(blocks)]


def _found_in(docs: DataFrame, needles: pa.Table, normalized: bool) -> DataFrame:
    """item_id, doc_id, nth, char_start, char_end for every occurrence, overlapping ones too, of a block of needles.

    All needles of a block are looked for in one pass over each text by an automaton. Normalized ones are looked for in
    the normalized text, and their places are mapped back to the source only for texts that hold one."""
    forms: dict[str, list] = {}
    for item, needle in zip(needles.column("item_id").to_pylist(), needles.column("needle").to_pylist()):
        form = mapped_text(needle)[0] if normalized else needle
        if form:
            forms.setdefault(form, []).append(item)
    kind = needles.schema.field("item_id").type

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for form, items in forms.items():
            automaton.add_word(form, (len(form), items))
        if forms:
            automaton.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text or not forms:
                    continue
                shape, starts, ends = mapped_text(text) if normalized else (text, None, None)
                count: dict = {}
                for end, (size, items) in automaton.iter(shape):
                    first = end - size + 1
                    place = (starts[first], ends[end]) if normalized else (first, end + 1)
                    for item in items:
                        count[item] = count.get(item, 0) + 1
                        rows.append((item, doc, count[item], *place))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (kind, batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "doc_id", "nth", "char_start", "char_end"])

    ids = pa_type_name(kind)
    return docs.select("doc_id", "text").mapInArrow(
        find, f"item_id {ids}, doc_id {dict(docs.dtypes)['doc_id']}, nth int, char_start int, char_end int"
    )


def pa_type_name(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def all_spans(docs: DataFrame, needles: DataFrame, normalized: bool = False) -> DataFrame:
    """item_id, doc_id, nth, char_start, char_end: every place of every needle; one scan of the texts per block of needles."""
    found = [_found_in(docs, block, normalized) for block in _needle_blocks(needles)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def exact_spans(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """item_id, doc_id, char_start, char_end: where a needle first occurs verbatim in a document."""
    return all_spans(docs, needles).filter("nth = 1").drop("nth")


def aligned_evidence(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """item_id, doc_id, method, nth, char_start, char_end, reason: all places of each needle in each document.

    A document that holds the needle verbatim gives its exact places, another that holds it after normalization (entities,
    NFKC, case, punctuation, white space; accents stay) those of its source characters. A needle without any place has one
    row without a document, with the reason: `empty` or `not_found`."""
    exact = all_spans(docs, needles).withColumn("method", F.lit("exact"))
    loose = all_spans(docs, needles, normalized=True).withColumn("method", F.lit("normalized"))
    places = exact.unionByName(loose.join(exact.select("item_id", "doc_id").distinct(), ["item_id", "doc_id"], "left_anti"))
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\s\p{P}]", "")), F.lit(0)) == 0
    rest = (
        needles.select("item_id", F.when(blank, "empty").otherwise("not_found").alias("reason"))
        .join(places.select("item_id").distinct(), "item_id", "left_anti")
        .withColumn("method", F.lit("unresolved"))
    )
    return places.unionByName(rest, allowMissingColumns=True).select("item_id", "doc_id", "method", "nth", "char_start", "char_end", "reason")


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of all occurrences, overlapping ones too."""
    places = F.sequence(F.lit(1), F.length(text) - F.length(needle) + 1)
    found = F.filter(places, lambda i: F.substring(text, i, F.length(needle)) == needle)
    fits = (F.length(needle) > 0) & (F.length(needle) <= F.length(text))
    return F.when(fits, F.transform(found, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def merged_intervals(rows: DataFrame, key: str | list[str]) -> DataFrame:
    """key, start, end: overlapping and touching half-open intervals merged."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.filter("end > start")
        .withColumn("fresh", fresh)
        .withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def span_coverage(spans: DataFrame, intervals: DataFrame, span_key: list[str], join_key: list[str]) -> DataFrame:
    """span_key, coverage: the covered share of each span by merged intervals that share join_key; 0 without any.

    spans: span_key, join_key, start, end; intervals: join_key, start, end."""
    cover = intervals.select(*join_key, F.col("start").alias("cs"), F.col("end").alias("ce"))
    meets = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in join_key]
    condition = (F.col("cs") < F.col("end")) & (F.col("ce") > F.col("start"))
    for m in meets:
        condition = m & condition
    # least() and greatest() pass over nulls, so a span without an interval has to be told apart.
    overlap = F.when(F.col("cs").isNotNull(), F.least("end", "ce") - F.greatest("start", "cs"))
    return (
        spans.alias("s")
        .join(cover.alias("c"), condition, "left")
        .groupBy(*[F.col(f"s.{k}").alias(k) for k in span_key], "start", "end")
        .agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("covered"))
        .withColumn("coverage", F.col("covered") / (F.col("end") - F.col("start")))
        .drop("covered")
    )


def prefix_coverage(hits: DataFrame, spans: DataFrame, group: str, depths: tuple[int, ...]) -> DataFrame:
    """group, k, coverage: the best coverage of any of the group's spans by the chunks of its first k hits.

    hits: group, rank, doc_id, start, end; spans: group, doc_id, span_start, span_end. Each prefix is merged apart, as a
    span may be covered by several chunks together."""
    ks = hits.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in depths])).alias("k"))
    prefix = hits.crossJoin(F.broadcast(ks)).filter("rank <= k").select(group, "k", "doc_id", "start", "end")
    cover = merged_intervals(prefix, [group, "k", "doc_id"])
    asked = spans.crossJoin(F.broadcast(ks)).select(group, "k", "doc_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    covered = span_coverage(asked, cover, [group, "k", "doc_id"], [group, "k", "doc_id"])
    return covered.groupBy(group, "k").agg(F.max("coverage").alias("coverage"))


def monotonicity_violations(labels: DataFrame, group: list[str], k: str, y: str) -> DataFrame:
    """Rows whose label is lower than at the smaller depth before; reported, not repaired."""
    before = F.lag(y).over(Window.partitionBy(*group).orderBy(k))
    return labels.withColumn("before", before).filter(F.col("before") > F.col(y)).drop("before")


def stratum(impossible: Column, positive: Column, coverage: Column, right_document: Column) -> Column:
    """Exclusive sampling strata, first match wins."""
    return (
        F.when(impossible, "benchmark_impossible")
        .when(positive, "automatic_positive")
        .when(coverage > 0, "partial_overlap")
        .when(right_document, "correct_document_insufficient")
        .otherwise("wrong_document_retrieval")
    )


def overlapping(claims: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Claims (key, start, end) with `flagged`: whether a label interval of the key overlaps."""
    marks = labels.select(F.col(key).alias("lk"), F.col("start").alias("ls"), F.col("end").alias("le"))
    hit = claims.join(
        marks,
        (F.col(key) == F.col("lk")) & (F.greatest("start", "ls") < F.least("end", "le")),
        "left_semi",
    ).select(*claims.columns, F.lit(True).alias("flagged"))
    return claims.join(hit, claims.columns, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
