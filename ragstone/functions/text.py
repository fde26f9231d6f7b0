"""Text functions as columns; Arrow UDFs only where Spark has no counterpart (NFKC, HTML entities, offset maps, LCS).

Where an Arrow function is needed for some texts only, the others pass it as nulls and stay in the JVM."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# Patterns and lists that results depend on.
TOKEN = r"[\p{L}\p{N}_]+(?:[./:-]+[\p{L}\p{N}_]+)*"
ASCII_TOKEN = r"[a-z0-9_./:+#-]+"
DATA_URI = r"(?i)data:[a-z0-9.+/-]*;base64,[a-z0-9+/=]+"
BASE64_RUN = r"[A-Za-z0-9+/=]{250,}"
#: White space of claims: \s without the vertical tab.
SPACE = r"[ \t\n\f\r]"
BULLET = r"^\s*(?:[-*•]+|\(?\d+[.)]|[A-Za-z][.)])\s+"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9(<\[])"
BREAK_TAG = r"(?i)<\s*(?:br\s*/?|/\s*(?:li|p|div)|li|p|div)\s*>"
ANY_TAG = r"<[^>]+>"
FINITE_VERB = (
    r"(?i)\b(?:is|are|was|were|be|been|has|have|had|can|could|must|should|will|would|use|uses|set|sets|run|runs|"
    r"select|selects|click|clicks|configure|configures|install|installs|create|creates|remove|removes|add|adds|enable|"
    r"enables|disable|disables|specify|specifies|enter|enters|type|types|returns?|requires?|allows?)\b|\b\w+(?:ed|ing)\b"
)
PASSAGE_MARKER = r"(?im)^\s*passage\s+(\d+)\s*:"
CLAIM_WORD = r"\w+(?:[./:-]+\w+)*"
IDENTIFIER = (
    r"(?i)^(?:.*[_-].*|(?=.*[a-z])(?=.*\d)[a-z0-9./:-]+|[a-z0-9_/-]+(?:\.[a-z0-9_/-]+)+|v?\d+(?:\.\d+)+)$"
)
RESPONSE_ID = r"^[A-Za-z0-9_.:-]+$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


#: White space as Unicode has it; the six ASCII characters alone are \\s.
BLANK = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: Normalized text and, for each of its characters, where it starts and ends in the source.
MAPPED = StructType(
    [StructField("text", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))]
)


#: Characters that NFKC leaves alone and whose case folding is their lower case, but for ß: ASCII, accented Latin letters,
#: dashes and quotes. No combining marks, ligatures, width variants or other scripts.
PLAIN = r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201E\u2022"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _where_needed(function, text: Column, pattern: str, otherwise: Column) -> Column:
    """function(text) for texts with the pattern, `otherwise` for all others; those reach the function as nulls."""
    return F.coalesce(function(F.when(text.rlike(pattern), text)), otherwise)


def nfkc(text: Column) -> Column:
    """Compatibility composition, as Unicode defines it."""
    return _where_needed(_nfkc, text, f"[^{PLAIN}]", text)


def folded(text: Column) -> Column:
    """NFKC and full case folding."""
    return _where_needed(_nfkc_casefold, text, f"[^{PLAIN}]", F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def tokens(text: Column) -> Column:
    """Words with inner separators kept (v4.1.1, foo:bar); no stop words, no stemming."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def normalized_corpus_text(text: Column) -> Column:
    """Line ends to LF, NFKC, embedded data URIs to a space, white space collapsed."""
    return collapsed(F.regexp_replace(nfkc(F.regexp_replace(text, r"\r\n?", "\n")), DATA_URI, " "))


def normalized_generated_text(text: Column) -> Column:
    """NFKC, white space collapsed."""
    return collapsed(nfkc(text))


def provenance(question_id: Column) -> Column:
    """What stands before the first `_Q` of an id."""
    return F.split(question_id, "_Q")[0]


def is_timestamp(text: Column) -> Column:
    """Whether the whole text is an ISO timestamp with a zone that exists; null is not one."""
    return F.coalesce(text.rlike(TIMESTAMP) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def is_identifier(text: Column) -> Column:
    """Whether the whole text is an id of letters, digits and _ . : -; null is not one."""
    return F.coalesce(text.rlike(RESPONSE_ID), F.lit(False))


def placeholder_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DATA_URI))


def normalized_question(text: Column) -> Column:
    """Folded, punctuation (not symbols) to a space, white space collapsed."""
    return collapsed(F.regexp_replace(folded(text), r"\p{P}", " "))


def question_hash(text: Column) -> Column:
    return F.sha2(normalized_question(text), 256)


def cleaned_document(text: Column) -> Column:
    """Without data URIs, long base64 runs and lines that mention base64."""
    lines = F.filter(F.split(F.regexp_replace(text, DATA_URI, " "), "\n"), lambda x: ~F.contains(F.lower(x), F.lit("base64")))
    return collapsed(F.regexp_replace(F.array_join(lines, "\n"), BASE64_RUN, " "))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def unescaped(text: Column) -> Column:
    """All HTML entities, named and numeric; those that occur most stay in the JVM, &amp; last, so that nothing is
    unescaped twice."""
    common = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    named = "|".join(e.strip("&;") for e in ENTITIES if e != "&#39;")
    return _where_needed(_unescape, text, rf"&(?!(?:{named}|#39);)[#A-Za-z]", common)


def without_markup(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescaped(html), BREAK_TAG, "\n"), ANY_TAG, " ")


def sentences(text: Column) -> Column:
    """Lines, bullets stripped, cut after . ! ? before an opening character; empty ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, BULLET, "")))
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_GAP)))
    return F.filter(F.transform(cut, collapsed), lambda s: s != "")


def reference_claims(answer: Column) -> Column:
    """Sentences of a reference answer; a sentence splits at semicolons only if every part could stand alone."""
    words = lambda x: F.regexp_count(x, F.lit(CLAIM_WORD))
    parts = lambda s: F.filter(F.transform(F.split(s, ";"), lambda p: F.trim(p)), lambda p: p != "")
    alone = lambda p: F.forall(p, lambda x: (words(x) >= 4) & x.rlike(FINITE_VERB))
    split = F.transform(
        sentences(without_markup(F.regexp_replace(answer, r"\r\n?", "\n"))),
        lambda s: F.when((F.size(parts(s)) > 1) & alone(parts(s)), parts(s)).otherwise(F.array(s)),
    )
    usable = answer.isNotNull() & ~F.trim(answer).isin("", "-")
    return F.when(usable, F.flatten(split)).otherwise(F.array().cast("array<string>"))


def passages(text: Column) -> Column:
    """Array of (number, text) from `passage N:` markers at line starts, by number; no marker: one passage. Empty passages
    are left out, so an empty text has none."""
    numbers = F.regexp_extract_all(text, F.lit(PASSAGE_MARKER), F.lit(1))
    bodies = F.slice(F.split(text, PASSAGE_MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    marked = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("number"), stripped(b).alias("text")))
    alone = F.array(F.struct(F.lit(1).alias("number"), stripped(text).alias("text")))
    found = F.filter(F.when(F.size(numbers) > 0, marked).otherwise(alone), lambda p: p["text"] != "")
    # Stable: passages of one number stay in the order of the source.
    placed = F.sort_array(F.transform(found, lambda p, i: F.struct(p["number"].alias("number"), i.alias("i"), p["text"].alias("text"))))
    return F.coalesce(
        F.transform(placed, lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text"))),
        F.array().cast("array<struct<number:int,text:string>>"),
    )


def segmented_claims(response: Column) -> Column:
    """Array of (claim_index, start, end, text) with exact code-point offsets into the response.

    The text is cut into separators and bodies that add up to it, so offsets are running sums of lengths. White space is
    SPACE alone. Lines are cut apart, so a marker that ends its line marks nothing and is a claim itself."""
    cut = F.regexp_replace(response, r"(?<=[.!?])([ \t\f\r]+)(?=[A-Z0-9(<\[])", "\u0001$1")
    pieces = F.flatten(F.transform(F.split(cut, r"(?<=\n)"), lambda x: F.split(x, "\u0001")))
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(_claim(s["at"], p))).alias("out")),
        lambda s: s["out"],
    )
    kept = F.filter(placed, lambda c: c["text"].rlike(r"[\p{L}\p{N}]"))
    return F.transform(
        kept, lambda c, i: F.struct((i + 1).alias("claim_index"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"))
    )


def _claim(at: Column, piece: Column) -> Column:
    lead = F.length(F.regexp_extract(F.rtrim(piece, F.lit("\n")), BULLET.replace(r"\s", SPACE), 0))
    blank = F.length(F.regexp_extract(piece, rf"^{SPACE}+", 0))
    start = at + F.greatest(lead, blank)
    # Not $, which also stands before a last line end of any kind.
    text = F.regexp_replace(F.substring(piece, F.greatest(lead, blank) + 1, F.length(piece)), rf"{SPACE}+\z", "")
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def identifier_like(token: Column) -> Column:
    """Tokens that look like a version, a code, a path or a compound."""
    return token.rlike(f"(?U){IDENTIFIER}")


def judge_score(raw: Column) -> Column:
    """A judge's score 1 to 5 from free text: `score: N`, `N/5`, a lone digit, or a letter A to E."""
    found = [F.regexp_extract(raw, p, 1) for p in (r"(?i)score\s*[:=]?\s*([1-5])", r"\b([1-5])\s*/\s*5\b", r"\b([1-5])\b")]
    letter = F.regexp_extract(raw, r"\b([A-E])\b", 1)
    graded = F.when(letter != "", (F.lit(70) - F.ascii(letter)).cast("int"))
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found], graded)


@F.pandas_udf(MAPPED)
def mapped_alignment_text(text: pd.Series) -> pd.DataFrame:
    """Normalized text whose every character knows where it came from: entities, NFKC and case by cluster, punctuation
    to spaces, runs of white space to one."""
    rows = [mapped_text(t or "") for t in text]
    return pd.DataFrame(rows, columns=["text", "starts", "ends"])


_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?")


def mapped_text(text: str) -> tuple[str, list[int], list[int]]:
    """The normalized text, and where each of its characters starts and ends in the source."""
    units, at = [], 0
    while at < len(text):
        entity = _ENTITY.match(text, at) if text[at] == "&" else None
        raw = html.unescape(entity[0]) if entity else ""
        if entity and raw != entity[0]:
            stop = entity.end()
        else:
            stop = at + 1
            while stop < len(text) and unicodedata.combining(text[stop]):
                stop += 1
            raw = text[at:stop]
        units.append((raw, at, stop))
        at = stop
    out: list[tuple[str, int, int]] = []
    for raw, start, stop in units:
        for c in raw.lower() if raw.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", raw).casefold()):
            c = " " if c.isspace() or unicodedata.category(c).startswith("P") else c
            if c == " " and (not out or out[-1][0] == " "):
                if out:
                    out[-1] = (" ", out[-1][1], stop)
                continue
            out.append((c, start, stop))
    if out and out[-1][0] == " ":
        out.pop()
    return "".join(c for c, _, _ in out), [s for _, s, _ in out], [e for _, _, e in out]


@F.pandas_udf(DoubleType())
def rouge_l_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Longest common subsequence of lower-case [a-z0-9]+ tokens, as F1; 0 where either side has none."""
    word = re.compile(r"[a-z0-9]+")

    def score(p: str | None, r: str | None) -> float:
        a, b = word.findall((p or "").lower()), word.findall((r or "").lower())
        if not a or not b:
            return 0.0
        # A bit per token of a; each token of b extends the longest chains in one addition (Hyyro's recurrence).
        where: dict[str, int] = {}
        for i, w in enumerate(a):
            where[w] = where.get(w, 0) | 1 << i
        full = row = (1 << len(a)) - 1
        for w in b:
            hit = row & where.get(w, 0)
            row = (row + hit | row - hit) & full
        common = len(a) - row.bit_count()
        return 0.0 if not common else 2 * common / (len(a) + len(b))

    return pd.Series([score(p, r) for p, r in zip(prediction, reference)])
