"""Secret scans: three fixed patterns and a token-efficiency test.

The patterns (`assign`, `access`, `hex`) are searched in every whole text. Besides, strings of 16 or more characters of
the base64 alphabet, a letter among them, are put to a token-efficiency test: a byte-pair vocabulary learned from ordinary
text spells random characters with few characters a token, words and names with many. A string whose ratio of characters
to tokens is below `least_ratio` (below `short_ratio` if shorter than `long_chars`) is a `token` span, unless it is a known
kind of digest (hexadecimal of a digest's length), a UUID, a time, or an identifier made of words and numbers; only what
the vocabulary itself spells as words (`word_ratio`) makes an identifier. What spans of the fixed patterns leave of a
string is tested by itself; beside a hexadecimal run or an access key, `rest_chars` letters and digits are enough, at
`rest_ratio`.

Edge cases: a null text is empty; an empty text has no spans and the digest of the empty string; repeated rows are
scanned alike; positions are code points, end exclusive; an empty table gives an empty table; extra columns stay in
`redact_secrets` and aren't read by `secret_report`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: Maximal runs: the same matches as `[0-9a-f]+` of 16 characters or more, found without visiting the short ones.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: The fewest characters of a candidate.
CANDIDATE_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TIMESTAMP = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9]{2}-?[0-9]{2}-?[0-9]{2}Z?")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class SecretConfig:
    ranks_path: str = ""
    pattern: str = ""
    assign_chars: int = 12
    least_ratio: float = 1.9
    long_chars: int = 20
    short_ratio: float = 1.8
    rest_chars: int = 6
    rest_ratio: float = 1.6
    word_ratio: float = 2.5
    mask: str = "[SECRET]"


def default_config() -> SecretConfig:
    import public_tokenizers

    return SecretConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(text: str, encode, word_ratio: float) -> bool:
    """Words and numbers joined by single separators or by case, such as max_retry_count2 or Build-2024-09-30; a run of
    letters is a word if the vocabulary spells it with `word_ratio` characters a token or more."""
    pieces = re.split(r"[+/_=-]+", text)
    parts = [x for p in pieces for x in PART.findall(p) if len(x) >= 4 and x.isalpha()]
    if sum(map(len, parts)) < 0.6 * len(text):
        return False
    return sum(len(x) for x in parts if len(x) >= word_ratio * len(encode(x))) >= 0.6 * len(text)


def looks_random(text: str, encode, config: SecretConfig) -> bool:
    if len(text) < CANDIDATE_CHARS or not any(c.isalpha() for c in text):
        return False
    if UUID.fullmatch(text) or TIMESTAMP.fullmatch(text) or len(text) in DIGEST_LENGTHS and DIGEST.fullmatch(text):
        return False
    ratio = config.least_ratio if len(text) >= config.long_chars else config.short_ratio
    return len(text) / len(encode(text)) < ratio and not is_identifier(text, encode, config.word_ratio)


def is_rest(text: str, encode, config: SecretConfig) -> bool:
    """Whether a short string beside a hexadecimal run or an access key reads as more of it."""
    inner = text.strip("+/_=-")
    return len(inner) >= config.rest_chars and inner.isalnum() and len(inner) / len(encode(inner)) < config.rest_ratio


def outside(start: int, end: int, spans: list[tuple[int, int, int]], first: int) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no span from the first on covers; spans ascend."""
    for i in range(first, len(spans)):
        s, _, e = spans[i]
        if s >= end:
            break
        if start < s:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def find_spans(text: str, encode, config: SecretConfig) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), ascending."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= config.assign_chars]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, at = sorted(found), 0
    edges = {x for s, k, e in base if k for x in (s, e)}
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        for s, e in outside(m.start(), m.end(), base, at):
            rest = e - s < CANDIDATE_CHARS and (s in edges or e in edges)
            if (is_rest if rest else looks_random)(text[s:e], encode, config):
                found.append((s, 3, e))
    return sorted(found)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, done = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[done:start], mask]
        done = end
    return "".join([*out, text[done:]])


def _printed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_report(docs: DataFrame, config: SecretConfig | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token."""
    config = config or default_config()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(config.ranks_path, config.pattern).encode_ordinary
        for batch in batches:
            rows = [find_spans(t or "", encode, config) for t in batch.column("text").to_pylist()]
            counts = [[sum(x[1] == k for x in spans) for spans in rows] for k in range(len(KINDS))]
            base = [hashlib.sha256(_printed([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts[:3]],
                    pa.array(base, pa.string()),
                    pa.array([_printed(spans) for spans in rows], pa.string()),
                    pa.array(counts[3], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, config: SecretConfig | None = None) -> DataFrame:
    """The documents with every span masked; n_chars, where there is one, follows the text. Null texts stay null."""
    config = config or default_config()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(config.ranks_path, config.pattern).encode_ordinary
        for batch in batches:
            texts = [
                t and masked(t, find_spans(t, encode, config), config.mask) for t in batch.column("text").to_pylist()
            ]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
