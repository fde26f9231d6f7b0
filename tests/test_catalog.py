"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from ragstone.functions.text import mapped_text
from ragstone.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for p in Path(SF).iterdir():
        connection.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


#: Fitted models, whose operators test_operators.py holds against known answers.
LEARNED = {
    "forest_out_of_fold", "calibrated_models", "feature_ablation", "candidate_search", "permutation_importance", "logistic_out_of_fold",
}


def test_every_query_is_compared_or_tested_here():
    from tests import test_systems

    here = {n[len("test_"):] for module in (globals(), vars(test_systems)) for n in module if n.startswith("test_")}
    missing = set(QUERIES) - set(ORACLE_SQL) - here - LEARNED
    assert not missing, missing


def read(spark, name, *columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()


def squeezed(text):
    return re.sub(r"\s+", " ", text).strip(" ")


def test_page_text(spark):
    block, tag = re.compile(r"(?i)<\s*(?:br\s*/?|/\s*(?:li|p|div)|li|p|div)\s*>"), re.compile(r"<[^>]+>")
    want = {r.page_id: hashlib.sha256(squeezed(tag.sub(" ", block.sub("\n", html.unescape(r.html)))).encode()).hexdigest() for r in read(spark, "pages", "page_id", "html")}
    assert {r.page_id: r.text_sha256 for r in QUERIES["page_text"](spark, SF).collect()} == want


def test_cleaned_documents(spark):
    def clean(text):
        text = re.sub(r"(?i)data:[a-z0-9.+/-]*;base64,[a-z0-9+/=]+", " ", text)
        text = "\n".join(line for line in text.split("\n") if "base64" not in line.lower())
        return squeezed(re.sub(r"[A-Za-z0-9+/=]{250,}", " ", text))

    want = {r.doc_id: hashlib.sha256(clean(r.text).encode()).hexdigest() for r in read(spark, "documents", "doc_id", "text")}
    assert {r.doc_id: r.clean_sha256 for r in QUERIES["cleaned_documents"](spark, SF).collect()} == want


def test_evidence_alignment(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents", "doc_id", "text")}
    got = defaultdict(set)
    for r in QUERIES["evidence_alignment"](spark, SF).collect():
        got[r.item_id, r.doc_id, r.method].add((r.char_start, r.char_end))
    loose = lambda t: mapped_text(t)[0]
    shapes = {i: loose(t) for i, t in docs.items()}
    for item in read(spark, "benchmark", "item_id", "text"):
        places = 0
        for doc, text in docs.items():
            exact = {(m.start(), m.start() + len(item.text)) for m in re.finditer(f"(?={re.escape(item.text)})", text)}
            assert got.get((item.item_id, doc, "exact"), set()) == exact
            found = got.get((item.item_id, doc, "normalized"), set())
            if exact or loose(item.text) not in shapes[doc]:
                assert not found
            else:
                assert found and all(loose(text[a:b]) == loose(item.text) for a, b in found)
            places += len(exact) + len(found)
        assert ((item.item_id, None, "unresolved") in got) == (places == 0)


def test_model_token_chunks(spark):
    from ragstone.plans.alignment import bpe_offsets

    got = defaultdict(dict)
    for r in QUERIES["model_token_chunks"](spark, SF).collect():
        got[r.doc_id][r.chunk_index] = (r.char_start, r.char_end, r.chunk_sha256)
    offsets = bpe_offsets()
    for r in read(spark, "documents", "doc_id", "text"):
        at, want, first = offsets(r.text), {}, 0
        while at:
            part = at[first : first + 224]
            want[len(want)] = (part[0][0], part[-1][1], hashlib.sha256(r.text[part[0][0] : part[-1][1]].encode()).hexdigest())
            if first + 224 >= len(at):
                break
            first += 176
        assert got.get(r.doc_id, {}) == want


def test_input_files(spark):
    got = {r.path: (r.bytes, r.sha256) for r in QUERIES["input_files"](spark, SF).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(SF).iterdir()}


def test_question_components(spark):
    rows = read(spark, "lineitem", "l_orderkey", "l_partkey")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        a, b = find(("o", r.l_orderkey)), find(("p", r.l_partkey))
        parent[max(a, b)] = min(a, b)
    least = {}
    for r in rows:
        root = find(("o", r.l_orderkey))
        least[root] = min(least.get(root, r.l_orderkey), r.l_orderkey)
    want = {r.l_orderkey: least[find(("o", r.l_orderkey))] for r in rows}
    assert {r.node: r.component for r in QUERIES["question_components"](spark, SF).collect()} == want


def test_reference_claim_rows(spark):
    texts = {r.item_id: r.text for r in read(spark, "benchmark", "item_id", "text")}
    claims = defaultdict(list)
    for r in QUERIES["reference_claim_rows"](spark, SF).orderBy("item_id", "claim_index").collect():
        claims[r.item_id].append(r.claim)
    gap = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(<\[])")
    for i, text in texts.items():
        if not re.search(r"[;<&]|^\s*(?:[-*•]|\(?\d+[.)]|[A-Za-z][.)])", text, re.M):
            assert claims[i] == [squeezed(s) for line in text.split("\n") for s in gap.split(line) if squeezed(s)]


def test_rouge_l_scores(spark):
    for r in QUERIES["rouge_l_scores"](spark, SF).collect():
        assert 0 <= r.rouge_l_f1 <= 1


def test_human_gates(spark):
    rows = {r.gate: r for r in QUERIES["human_gates"](spark, SF).collect()}
    mine = QUERIES["human_annotator_results"](spark, SF).filter("annotator_id = 'a1'").first()
    assert rows["accuracy"].observed == mine.accuracy and rows["precision"].observed == mine.precision
    assert all(r.status == ("pass" if r.observed >= r.minimum else "fail") for r in rows.values())


def test_grouped_split(spark):
    rows = QUERIES["grouped_split"](spark, SF).collect()
    labelled = spark.read.parquet(f"{SF}/labels.parquet").count()
    assert {r.split for r in rows} <= {"train", "validation", "test"} and sum(r.total for r in rows) == labelled
    share = {r.split: r.total / labelled for r in rows}
    assert abs(share["train"] - 0.7) < 0.1 and abs(share["validation"] - 0.15) < 0.1


def test_balanced_annotation_sample(spark):
    rows = QUERIES["balanced_annotation_sample"](spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and max(Counter(r.lang for r in rows).values()) <= 10


def test_exact_tests(spark):
    for r in QUERIES["exact_tests"](spark, SF).collect():
        assert all(0 <= v <= 1 for k, v in r.asDict().items() if k.startswith("p") and isinstance(v, float))


def test_context_units_top3(spark):
    rows = QUERIES["context_units_top3"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.response_id, r.claim_index].append(r)
    assert by and all(len(x) <= 3 and sorted(r.place for r in x) == list(range(1, len(x) + 1)) for x in by.values())
    assert all(max(Counter(r.chunk_id for r in x).values()) <= 2 for x in by.values())


def test_semantic_condition_scores(spark):
    for r in QUERIES["semantic_condition_scores"](spark, SF).collect():
        assert r.claim_count > 0 and r.minimum_claim_entailment <= r.mean_claim_entailment + 1e-12
        assert r.maximum_selected_premise_contradiction <= r.maximum_any_unit_contradiction


def test_extractive_answers(spark):
    said = {r.response_id: r.answer for r in QUERIES["extractive_answers"](spark, SF).collect()}
    turns = {f"{r.conv_id}-{r.turn}": r.text for r in read(spark, "conversations", "conv_id", "turn", "text")}
    assert said and all(word in turns[i].split() or word in squeezed(turns[i]) for i, t in said.items() for word in t.split())


def test_packed_contexts(spark):
    texts = {r.doc_id: r.text for r in read(spark, "documents", "doc_id", "text")}
    for r in QUERIES["packed_contexts"](spark, SF).collect():
        assert (r.pieces or 0) <= max(0, len(texts[r.doc_id])) and (r.longest is None or r.longest <= max(700, len(texts[r.doc_id])))


def test_passage_rows(spark):
    parts = {}
    for r in QUERIES["passage_rows"](spark, SF).orderBy("item_id", "number").collect():
        parts.setdefault(r.item_id, []).append(r.text)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {i: "".join("".join(p).split()) for i, p in parts.items()} == {i: "".join(t.split()) for i, t in texts.items()}
    assert all(len(p) == 2 for p in parts.values())


#: A marker at a line's end, alone and before a capital; line ends and white space of other kinds; letters whose lower
#: case depends on their place; a turn without a text.
ODD_TURNS = [
    (1, 0, "user", "ΟΔΟΣ İx word"), (1, 1, "assistant", "1.\nthe word\nA. \nDef ghi. a.\n- \nend"), (1, 2, "user", None),
    (1, 3, "assistant", "1.\r\n <y z\n\x0b 2) odd. \x0bNext ΟΔΟΣ \x85"), (1, 4, "assistant", "word  "), (1, 5, "assistant", "İx. Σ ΟΔΟΣ a b c"),
    (2, 0, "assistant", None), (2, 1, "user", ""), (2, 2, "assistant", "b)\n\n(x y.  Z\t\nword"),
]


@pytest.mark.parametrize("name", [
    "claim_segments", "claim_offset_check", "claim_candidate_top3", "claim_support_scores", "label_span_overlap", "response_grounding", "response_validation",
])
def test_claims_of_odd_turns_like_sql(spark, tmp_path, name):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    found = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [tuple(plain(x) for x in r) for r in found.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted(want, key=repr)
