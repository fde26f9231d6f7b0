"""Packing token ids into sequences by minimum bin slack.

A document's ids are those of the tokenizer's vocabulary and an end id. It is cut every `window` ids; full pieces are
sequences by themselves and the remainders are packed: for each window the longest remainder left is taken, and a
subset-sum dynamic programme over a bitset (bit s: sum s can be reached, multiplicities in binary steps) finds the
multiset of remaining lengths that comes closest to what is left of the window; the counts are read back from the
bitsets. As remainders of equal length are alike, a window's multiset is used as often as the counts allow at once.

Documents are packed in blocks of about `block_docs`, or of `block_chars` characters where they are long, dealt by a
hash (equal rows also by their number within a task), each in one task with memory bounded by the block and the longest
text. Ids move once, to their block, and
`packed_pieces` gives them with every piece; the query's checksums are those of its ids. A block wastes about one window,
one in several hundred.

Ids are computed with the vocabulary's ranks, several times as fast as the tokenizer and with equal ids; the tokenizer's
special strings are ids of their own, between which texts are encoded by themselves. Long texts are encoded in slices cut
where a letter is followed by a space and a letter, which no pre-token spans, so that the encoder's memory doesn't follow
the longest text; a stretch without such a place is encoded as a whole.

Edge cases: a null text is empty and has the end id only; repeated rows are packed as often as they occur; null ids are
allowed; an empty table gives an empty table; further columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import encoding

SEAM = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@dataclass(frozen=True)
class PackConfig:
    tokenizer_path: str = ""
    ranks_path: str = ""
    pattern: str = ""
    window: int = 2048
    end_id: int = 1
    block_docs: int = 8192
    block_chars: int = 1 << 26
    slice_chars: int = 1 << 20


def default_config() -> PackConfig:
    import public_tokenizers as p

    return PackConfig(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


@lru_cache(maxsize=2)
def special_ids(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern for the tokenizer's special strings, longest first, and their ids."""
    from tokenizers import Tokenizer

    ids = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
    return (re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def slices(text: str, size: int) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        seam = SEAM.search(text, start + size)
        if not seam:
            break
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


def token_ids(text: str, config: PackConfig) -> np.ndarray:
    """The ids of a text, end id included."""
    special, names = special_ids(config.tokenizer_path)
    encode = encoding(config.ranks_path, config.pattern).encode_ordinary
    parts, at = [], 0

    def plain(piece: str) -> None:
        parts.extend(np.array(encode(x), np.uint32) for x in slices(piece, config.slice_chars))

    for found in special.finditer(text) if special else ():
        plain(text[at : found.start()])
        parts.append(np.array([names[found[0]]], np.uint32))
        at = found.end()
    plain(text[at:])
    return np.concatenate([*parts, np.array([config.end_id], np.uint32)])


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest that is at most room."""
    reached, whole, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            steps.append((length, take, reached))
            reached |= (reached << (take * length)) & whole
            left, step = left - take, 2 * step
        if reached >> room:
            break
    at, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many windows take it), until no length is left."""
    counts, out = dict(counts), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fill({k: c for k, c in counts.items() if c}, window - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        out.append((chosen, times))
    return out


def tokenized(docs: DataFrame, config: PackConfig) -> DataFrame:
    """doc_id, ids (four bytes each, the low one first) and nth: rows equal in both are numbered within a task.

    Which of equal rows gets which number doesn't matter, so a task that is run again deals alike."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                some = batch.slice(part, 1000)
                ids = [token_ids(text or "", config).astype("<u4").tobytes() for text in some.column("text").to_pylist()]
                nth = []
                for known, x in zip(some.column("doc_id").to_pylist(), ids):
                    key = xxhash.xxh3_64_intdigest(x, seed=xxhash.xxh3_64_intdigest(repr(known)))
                    nth.append(seen.get(key, 0))
                    seen[key] = nth[-1] + 1
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(nth, pa.int64())], names=["doc_id", "ids", "nth"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary, nth long")


def packed_pieces(docs: DataFrame, config: PackConfig | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset; one row per piece, with its ids as `tokenized` has them.

    A sequence is the ids of its pieces in the order of their offset."""
    config = config or default_config()
    count, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // config.block_docs), -(-chars // config.block_chars))
    block = F.pmod(F.xxhash64("doc_id", "ids", "nth"), F.lit(blocks))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        docs = table.column("doc_id").combine_chunks()
        known, ids = docs.to_pylist(), table.column("ids").to_pylist()
        sizes = [len(x) // 4 for x in ids]
        first = key[0].as_py() << 32
        order = sorted(range(len(sizes)), key=lambda i: ((known[i] is None, known[i]), ids[i]))
        rows: list[tuple] = []  # position, start, length, sequence, offset
        rest: dict[int, list[int]] = defaultdict(list)
        used = 0
        for i in order:
            full, left = divmod(sizes[i], config.window)
            for k in range(full):
                rows.append((i, k * config.window, config.window, first + used, 0))
                used += 1
            if left:
                rest[left].append(i)
        for chosen, times in plan({k: len(v) for k, v in rest.items()}, config.window):
            for _ in range(times):
                offset = 0
                for length, n in chosen.items():
                    for _ in range(n):
                        i = rest[length].pop()
                        rows.append((i, sizes[i] - length, length, first + used, offset))
                        offset += length
                used += 1
        at = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 5
        pieces = pa.array([ids[i][4 * start : 4 * (start + length)] for i, start, length, _, _ in rows], pa.binary())
        return pa.table(
            [docs.take(at[0]), at[1], at[2], pieces, pa.array(sizes, pa.int64()).take(at[0]), at[3], at[4]], names=names
        )

    kinds = {"doc_id": dict(docs.dtypes)["doc_id"], "ids": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)
    return tokenized(docs, config).select("doc_id", "ids", block.alias("block")).groupBy("block").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, config: PackConfig | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece of packed_pieces."""
    return packed_pieces(docs, config).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
