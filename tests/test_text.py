import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ragstone.functions import text as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_tokens_keep_inner_separators(spark):
    assert one(spark, "Error-Code_42 v4.1.1.2 at host:8080/path.", X.tokens) == ["error-code_42", "v4.1.1.2", "at", "host:8080/path"]
    assert one(spark, "Straße STRASSE", X.tokens) == ["strasse", "strasse"]
    assert one(spark, "C++ C# foo@bar x=y", X.tokens) == ["c", "c", "foo", "bar", "x", "y"]
    assert one(spark, "", X.tokens) == [] and one(spark, None, X.tokens) is None


def test_question_normalization(spark):
    assert one(spark, "C++ vs. C#?", X.normalized_question) == "c++ vs c"
    hashes = {one(spark, t, X.question_hash) for t in ("What is  X?", "what is x", " WHAT, is X ")}
    assert len(hashes) == 1


def test_nfkc_and_offsets(spark):
    assert one(spark, "ﬁne Ｓtraße", X.folded) == "fine strasse"
    for text in ("ﬁ", "İstanbul", "ΣΊΣΥΦΟΣ", "e\u0301t\u00c9", "½ ² µ ª … ſ ŉ ǅ", "Ĳ ŀ", "plain ÀÖØöøž—“x”", "\u00a0x\u2003y", "ｶﾞ"):
        assert one(spark, text, X.folded) == unicodedata.normalize("NFKC", text).casefold()
        assert one(spark, text, X.nfkc) == unicodedata.normalize("NFKC", text)
    assert one(spark, None, X.folded) is None
    row = one(spark, "A &amp; B—é", X.mapped_alignment_text)
    assert row.text == "a b é" and row.starts == [0, 1, 8, 9, 10] and row.ends == [1, 8, 9, 10, 11]


def test_claims_have_exact_offsets(spark):
    text = "First one. Second (two)!\n- Bullet claim? Yes\n3) Numbered\n\n  !!  \n"
    got = one(spark, text, X.segmented_claims)
    assert [(c.claim_index, c.text) for c in got] == [(1, "First one."), (2, "Second (two)!"), (3, "Bullet claim?"), (4, "Yes"), (5, "Numbered")]
    assert all(text[c.start : c.end] == c.text for c in got)


def test_reference_claims(spark):
    page = "<ul><li>Open the file and set the flag; run the tool and check the log</li><li>Done; later</li></ul>"
    assert one(spark, page, X.reference_claims) == ["Open the file and set the flag", "run the tool and check the log", "Done; later"]
    assert one(spark, " - ", X.reference_claims) == [] and one(spark, None, X.reference_claims) == []


def test_passages(spark):
    assert [tuple(p) for p in one(spark, "passage 1:alpha\n Passage 2: beta\nx", X.passages)] == [(1, "alpha"), (2, "beta\nx")]
    assert [tuple(p) for p in one(spark, "plain", X.passages)] == [(1, "plain")]
    assert [tuple(p) for p in one(spark, "passage 2: b\npassage 3:\nPASSAGE 1: a\npassage 2: c", X.passages)] == [(1, "a"), (2, "b"), (2, "c")]
    assert one(spark, "  ", X.passages) == [] and one(spark, None, X.passages) == []


@pytest.mark.parametrize("raw,score", [("Score: 4", 4), ("3/5", 3), ("I say 2.", 2), ("Grade A", 5), ("grade E", 1), ("none", None)])
def test_judge_scores(spark, raw, score):
    assert one(spark, raw, X.judge_score) == score


def test_cleaning(spark):
    assert one(spark, "a data:image/png;base64,AAAA== b\nbase64 line\nc " + "Z" * 300, X.cleaned_document) == "a b c"
    assert one(spark, "a\r\nb\rc  d", X.normalized_corpus_text) == "a b c d"


def test_rouge_l(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "a c e"), ("", "x"), (None, None)], "p string, r string")
    got = [r[0] for r in rows.select(X.rouge_l_f1("p", "r")).collect()]
    assert got == pytest.approx([1.0, 4 / 7, 0.0, 0.0])


def test_plain_characters_need_no_function():
    """Whatever counts as plain is left alone by NFKC and folded by lower(), but for ß."""
    plain = re.compile(f"[{X.PLAIN}]")
    for c in map(chr, range(0x3000)):
        if plain.fullmatch(c):
            assert unicodedata.normalize("NFKC", c) == c and c.casefold() == c.lower().replace("ß", "ss"), hex(ord(c))


def test_entities(spark):
    for text in ("a &amp;lt; b", "&#65;&#x42; &eacute;&hellip;", "&lt;b&gt; &nbsp;&quot;&#39;", "&notit; & &x", "&copy 2020", "no entity"):
        want = html.unescape(text)
        got = one(spark, text, X.unescaped)
        assert got == want or got == want.replace("\xa0", " ")


def test_identifiers(spark):
    like = ["foo-bar", "foo_bar", "a1", "v1.2", "1.2.3", "config.sys", "host:8080", "x/y.z"]
    plain = ["foo", "123", "foo:bar", "é1", "a.b:c"]
    pattern = re.compile(X.IDENTIFIER)
    for token in like + plain:
        assert one(spark, token, X.identifier_like) == (pattern.fullmatch(token) is not None), token
    assert all(one(spark, t, X.identifier_like) for t in like) and not one(spark, "foo", X.identifier_like)


@pytest.mark.parametrize(
    "text,ok",
    [("2026-07-20T10:11:12Z", True), ("2026-07-20T10:11:12.5+02:00", True), ("2026-13-20T10:11:12Z", False), ("2026-07-20 10:11", False), ("x2026-07-20T10:11:12Z", False), (None, False)],
)
def test_timestamps(spark, text, ok):
    assert one(spark, text, X.is_timestamp) is ok


def test_generated_text_and_provenance(spark):
    assert one(spark, " ﬁne\u00a0 text\n here ", X.normalized_generated_text) == "fine text here"
    assert one(spark, "TRAIN_Q12_Q3", X.provenance) == "TRAIN" and one(spark, "plain", X.provenance) == "plain"
