"""Substring dedup: seed and extend.

A repeat is a run of `length` words that also starts in a document with a smaller doc_id. Documents are joined on
winnowed anchors, then matches are extended and merged:

 1. Seeds. Of the `length - seed_words + 1` runs of `seed_words` words in a window of `length` words, the one with the
    smallest hash is the window's anchor. Equal windows have equal anchors at equal places, so a window can only repeat
    if its anchor occurs in two documents. About one word in five starts an anchor.
 2. Join. Anchors of all documents meet by hash; those that two documents share stay, as a list per document.
 3. Extend. The windows of a document that share an anchor follow each other; a shared anchor is sent with 64 bits of
    hash for each of them. Windows of one anchor, or of one key of their own around a hot anchor, are told apart by these
    64 bits, so that unequal ones pass for equal about n * n / 2 ** 65 times among n (5e-8 for 1.3 million). Where anchors meet again, equal windows of documents other than the smallest are repeats.
 4. Maximal repeats. Per document, overlapping and touching repeats are merged into spans, and their words removed.

Skew: an anchor or window may occur in every document. `hot_share` of a bounded sample of documents tells which anchors
and windows are that common (at most sample_docs * words / (hot_share * sample_docs) of them). Hot anchors are known to
be shared and are not joined at all; windows around them meet by their own hash instead. For hot windows the smallest
doc_id is found by an aggregation that combines before it shuffles and has one row per hot window; their repeats are
then known where they stand. Of the other anchors, those in more than `crowd` documents, by an exact count, are treated
as hot ones from there on, so that no key brings together more than `crowd` documents with windows of their own. The
sample and the count only decide which way a window takes, never the result. Where windows meet, a worker holds a batch
and the distinct windows of one key. No pairs of documents are formed anywhere.

Texts are shuffled once, by doc_id, and that exchange serves both steps that need them.

Edge cases: a null text has no words; a document repeats nothing of itself; rows that share a doc_id are never smaller
than each other, and a position that is a repeat in one of them is removed in all of them; rows with a null doc_id are
neither sources nor changed; texts of fewer words than `length` are unchanged; an empty table gives an empty table;
further columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import among, anchors, run_hashes, split_words, word_hashes

SEED, KEY, CHECK = 1, 2, 3


@dataclass(frozen=True)
class SubstringConfig:
    length: int = 13
    seed_words: int = 5
    sample_docs: int = 4000
    hot_share: float = 0.01
    #: An anchor of more documents is a meeting point no longer; its windows meet by themselves.
    crowd: int = 50_000

    @property
    def span(self) -> int:
        return self.length - self.seed_words + 1


def _hashed(text: str | None, config: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, seed hashes (as signed numbers), and the anchor's position for each window."""
    hashes = word_hashes(text)
    seeds = run_hashes(hashes, config.seed_words, SEED)
    return hashes, seeds.view(np.int64), anchors(seeds, config.span)


def _emit(columns: list[tuple[list[np.ndarray], str]], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(x) if x else np.empty(0, kind)) for x, kind in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _anchor_rows(docs: DataFrame, config: SubstringConfig, hot: np.ndarray | None = None) -> DataFrame:
    """(doc_id, h), each anchor once per document; hot ones left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                _, seeds, at = _hashed(text, config)
                own = np.unique(seeds[np.unique(at)])
                if hot is not None and len(hot):
                    own = own[~among(own, hot)]
                found.append(own)
                ids.append(np.full(len(own), doc, np.int64))
            yield _emit([(ids, "int64"), (found, "int64")], ["doc_id", "h"])

    return docs.mapInArrow(find, "doc_id long, h long")


def _window_minima(docs: DataFrame, config: SubstringConfig, hot: np.ndarray) -> DataFrame:
    """(w, doc_id): for each hot window, the smallest doc_id of each batch that has it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(len(hot), np.iinfo(np.int64).max)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys = run_hashes(word_hashes(text), config.length, KEY).view(np.int64)
                at = np.searchsorted(hot, keys)
                at = at[(at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == keys)]
                least[at] = np.minimum(least[at], doc)
            there = least < np.iinfo(np.int64).max
            yield _emit([([hot[there]], "int64"), ([least[there]], "int64")], ["w", "doc_id"])

    return docs.mapInArrow(find, "w long, doc_id long")


def hot_keys(docs: DataFrame, config: SubstringConfig) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and windows that a share of the sampled documents have, both ascending.

    The sample is by a hash of doc_id; what comes to the driver is bounded by sample_docs, hot_share and the words of a
    text, not by the number of documents."""
    n = docs.count()
    every = max(1, n // config.sample_docs)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(every)) == 0)
    least = max(8, int(config.hot_share * n / every))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, keys = [], []
            for text in batch.column("text").to_pylist():
                hashes, seeds, at = _hashed(text, config)
                for kind, own in (
                    (0, np.unique(seeds[np.unique(at)])),
                    (1, np.unique(run_hashes(hashes, config.length, KEY).view(np.int64))),
                ):
                    keys.append(own)
                    kinds.append(np.full(len(own), kind, np.int32))
            yield _emit([(kinds, "int32"), (keys, "int64")], ["kind", "k"])

    counted = sample.select("text").mapInArrow(find, "kind int, k long").groupBy("kind", "k").count()
    common = counted.filter(F.col("count") >= least).select("kind", "k").toPandas()
    return tuple(np.sort(common.k[common.kind == kind].to_numpy(np.int64)) for kind in (0, 1))


def _extended(matched: DataFrame, config: SubstringConfig, hot: np.ndarray, windows: np.ndarray, least: np.ndarray) -> DataFrame:
    """(k, doc_id, at, ws): runs of windows around shared anchors.

    k is where they meet: the anchor's hash, or the window's own around a hot anchor. The low half of `at` is where the
    run starts, the high half marks the windows that are repeats already (hot ones of documents other than the
    smallest); ws has eight bytes for each window that isn't decided."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, at_, sizes, bodies = [], [], [], [], []

            def add(k: np.ndarray, doc: int, at: np.ndarray, size: np.ndarray, body: np.ndarray) -> None:
                for column, values in zip((keys, ids, at_, sizes, bodies), (k, np.full(len(k), doc, np.int64), at, size, body)):
                    column.append(values)

            for doc, text, shared, crowded in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "shared", "crowded"))):
                if not shared and not crowded and not len(hot):
                    continue
                hashes, seeds, at = _hashed(text, config)
                if not len(at):
                    continue
                starts = np.flatnonzero(np.diff(np.concatenate([[-1], at])))
                ends = np.concatenate([starts[1:], [len(at)]])
                seed = seeds[at[starts]]
                check = run_hashes(hashes, config.length, CHECK)
                if shared:
                    own = among(seed, np.sort(np.array(shared, np.int64)))
                    if own.any():
                        inside = np.repeat(own, ends - starts)
                        add(seed[own], doc, starts[own], (ends - starts)[own], check[inside])
                warm = among(seed, hot)
                if crowded:
                    warm |= among(seed, np.sort(np.array(crowded, np.int64)))
                if not warm.any():
                    continue
                where = np.flatnonzero(np.repeat(warm, ends - starts))
                key = run_hashes(hashes, config.length, KEY).view(np.int64)[where]
                common, sure = np.zeros(len(where), bool), np.zeros(len(where), bool)
                if len(windows):
                    place = np.minimum(np.searchsorted(windows, key), len(windows) - 1)
                    common = windows[place] == key
                    sure = common & (least[place] < doc)
                one = where[~common]
                add(key[~common], doc, one, np.ones(len(one), np.int64), check[one])
                known = where[sure]
                if len(known):
                    # Up to 32 windows a row; a key of their own spreads them.
                    firsts = known[np.concatenate([[True], known[1:] // 32 != known[:-1] // 32])] // 32 * 32
                    marks = np.zeros(len(firsts), np.uint64)
                    np.bitwise_or.at(marks, np.searchsorted(firsts, known // 32 * 32), np.uint64(1) << (known % 32).astype(np.uint64))
                    at_row = ((marks << np.uint64(32)) | firsts.astype(np.uint64)).view(np.int64)
                    spread = at_row ^ np.int64(doc * 0x9E3779B1 & 0x7FFFFFFFFFFFFFFF)
                    add(spread, doc, at_row, np.zeros(len(firsts), np.int64), np.empty(0, np.uint64))
            size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            body = np.concatenate(bodies) if bodies else np.empty(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            fixed = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (keys, ids, at_)]
            yield pa.RecordBatch.from_arrays([*fixed, blobs], names=["k", "doc_id", "at", "ws"])

    return matched.mapInArrow(find, "k long, doc_id long, at long, ws binary")


def _repeats(runs: DataFrame) -> DataFrame:
    """(doc_id, at): runs with a mark for each repeat in the high half of `at`; runs are dealt by k and sorted by (k, doc_id).

    Documents come in ascending order, so the first that has a window is its smallest. Of the key that a batch breaks off
    in, a worker keeps the distinct windows with their first document, not the rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, firsts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k, doc, at = (batch.column(c).to_numpy() for c in ("k", "doc_id", "at"))
            blobs = batch.column("ws")
            offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            body = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
            size = np.diff(offsets) // 8
            row = np.repeat(np.arange(len(k)), size)
            marks = (at >> 32) & 0xFFFFFFFF
            if key != k[0]:
                seen, firsts = seen[:0], firsts[:0]
            old = len(seen)
            ks = np.concatenate([np.full(old, k[0]), k[row]])
            windows = np.concatenate([seen, body])
            docs = np.concatenate([firsts, doc[row]])
            key = k[-1]
            if len(ks):
                nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                order = np.lexsort((windows, ks))
                new = np.concatenate([[True], (np.diff(ks[order]) != 0) | (np.diff(windows[order]) != 0)])
                heads = np.flatnonzero(new)
                least = np.minimum.reduceat(docs[order], heads)
                hit = order[docs[order] > least[np.cumsum(new) - 1]] - old
                hit = hit[hit >= 0]
                np.bitwise_or.at(marks, row[hit], np.int64(1) << nth[hit])
                last = ks[order][heads] == key
                seen, firsts = windows[order][heads][last], least[last]
            there = marks != 0
            starts = (marks[there] << 32) | (at[there] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(doc[there]), pa.array(starts)], names=["doc_id", "at"])

    return runs.mapInArrow(find, "doc_id long, at long")


def repeated_windows(docs: DataFrame, texts: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """doc_id, runs: where the repeats of a document start. docs and texts: (doc_id, text), texts dealt by doc_id."""
    hot, windows = hot_keys(docs, config)
    least = np.empty(0, np.int64)
    if len(windows):
        found = _window_minima(docs, config, windows).groupBy("w").agg(F.min("doc_id").alias("least")).toPandas()
        smallest = dict(zip(found.w, found.least))
        least = np.array([smallest[w] for w in windows], np.int64)
    meet, many = Window.partitionBy("h"), F.col("n") > config.crowd
    shared = (
        _anchor_rows(docs, config, hot)
        .withColumns({"least": F.min("doc_id").over(meet), "most": F.max("doc_id").over(meet), "n": F.count(F.lit(1)).over(meet)})
        .filter("least < most")
        .groupBy("doc_id")
        .agg(*[F.collect_list(F.when(there, F.col("h"))).alias(name) for name, there in (("shared", ~many), ("crowded", many))])
    )
    runs = _extended(texts.join(shared, "doc_id", "left"), config, hot, windows, least)
    return _repeats(runs.repartition("k").sortWithinPartitions("k", "doc_id")).groupBy("doc_id").agg(F.collect_list("at").alias("runs"))


def starts_of(runs: list[int] | None) -> np.ndarray:
    """The words at which repeats start, ascending, from runs with marks."""
    at = np.array(runs or [], np.int64)
    bits = ((at >> 32)[:, None] >> np.arange(32)) & 1
    row, bit = np.nonzero(bits)
    return np.unique((at & 0xFFFFFFFF)[row] + bit)


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal repeats [start, end) in words, from ascending starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    firsts, lasts = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]
    return [(int(a), int(b) + length) for a, b in zip(firsts, lasts)]


def dedup_substrings(docs: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """doc_id, n_words, spans (array of start and end in words), kept_text: the words kept, joined by one space."""
    rows = docs.select("doc_id", "text")
    if dict(docs.dtypes)["doc_id"] != "bigint":  # an alias would keep the two readers of the exchange from sharing it
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = rows.filter("doc_id is not null")
    texts = known.repartition("doc_id")
    found = texts.join(repeated_windows(known, texts, config), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = split_words(text)
                own = spans_of(starts_of(runs), config.length)
                left, at = [], 0
                for a, b in own:
                    left += words[at:a]
                    at = max(at, b)
                left += words[at:]
                sizes.append(len(words))
                spans.append([{"start": a, "end": min(b, len(words))} for a, b in own])
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "spans", "kept_text"],
            )

    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept_text string"
    unknown = rows.filter("doc_id is null").withColumn("runs", F.lit(None).cast("array<bigint>"))
    return found.unionByName(unknown).mapInArrow(cut, schema)


def substring_report(docs: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dedup_substrings(docs, config).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )
