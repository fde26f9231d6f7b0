"""Assembled feature rows, model inputs, answers and manifests against plain Python."""

import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragstone.functions.text import mapped_text  # noqa: F401
from ragstone.operators import models as L
from ragstone.operators.assembly import CONDITION_FEATURES
from ragstone.plans.catalog import QUERIES
from ragstone.plans.systems import rankings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+(?:[./:-]+\w+)*")


def folded(text):
    return text.lower().replace("ß", "ss")


@pytest.fixture(scope="module")
def data(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    return {n: read(n) for n in ("documents", "benchmark", "embeddings", "conversations")}


@pytest.fixture(scope="module")
def ranked(spark):
    out = defaultdict(list)
    for r in rankings(spark, SF).orderBy("item_id", "strategy", "rank").collect():
        out[r.item_id, r.strategy].append((r.doc_id, r.score))
    return out


def spread(values):
    return float(np.std(np.array(values, float)))


def test_condition_feature_rows(spark, data, ranked):
    docs = {r.doc_id: r for r in data["documents"]}
    words = {i: WORD.findall(folded(r.text)) for i, r in docs.items()}
    vector = {r.vec_id: np.array(r.embedding, float) for r in data["embeddings"]}
    df = Counter(w for own in words.values() for w in set(own))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    oov = math.log((len(docs) + 0.5) / 0.5)
    asked = {r.item_id: r.text for r in data["benchmark"]}
    like = re.compile(r"(?i)^(?:.*[_-].*|(?=.*[a-z])(?=.*\d)[a-z0-9./:-]+|[a-z0-9_/-]+(?:\.[a-z0-9_/-]+)+|v?\d+(?:\.\d+)+)$")
    seen = 0
    for r in QUERIES["condition_feature_rows"](spark, SF).collect():
        hits = ranked[r.item_id, r.strategy][: r.k]
        terms, chosen = WORD.findall(folded(asked[r.item_id])), [d for d, _ in hits]
        own, scores = set(terms), [s for _, s in hits]
        sets, lengths = [set(words[d]) for d in chosen], [len(words[d]) for d in chosen]
        vs, q = [vector[d % len(vector)] for d in chosen], vector[r.item_id % len(vector)]
        sims = [float(v @ q) for v in vs]
        shares = [len(own & s) / len(own) for s in sets]
        covered = own & set().union(*sets)
        origin = Counter(docs[d].source for d in chosen)
        pairs = [float(vs[i] @ vs[j]) for i in range(len(vs)) for j in range(i + 1, len(vs))]
        first, second = ({d for d, _ in ranked[r.item_id, s][: r.k]} for s in ("bm25", "dense"))
        weigh = lambda ws: sum(idf.get(w, oov) for w in ws)
        two = len(scores) > 1
        want = [
            len(asked[r.item_id]), len(terms), len(own), len(own) / len(terms), sum(t.isdigit() for t in terms), sum(t.isdigit() for t in terms) / len(terms),
            sum(bool(like.fullmatch(t)) for t in terms), sum(bool(like.fullmatch(t)) for t in terms) / len(terms),
            scores[0], scores[1] if two else None, scores[0] - scores[1] if two else None, sum(scores) / len(scores), spread(scores), min(scores), max(scores), max(scores) - min(scores),
            len(covered) / len(own), weigh(covered) / weigh(own), max(shares), sum(shares) / len(shares), spread(shares),
            max(sims), sum(sims) / len(sims), min(sims), spread(sims), sorted(sims)[-1] - sorted(sims)[-2] if two else None,
            len(chosen), sum(lengths), sum(lengths) / len(lengths), spread(lengths), len(origin), max(origin.values()) / len(chosen), 1 - len(origin) / len(chosen),
            sum(pairs) / len(pairs) if pairs else None, max(pairs) if pairs else None, len(first & second), len(first & second) / len(first | second), r.strategy, r.k,
        ]
        got = [r[c] for c in CONDITION_FEATURES]
        assert len(got) == 39
        for name, a, b in zip(CONDITION_FEATURES, got, want):
            assert a == b or (a is not None and b is not None and abs(a - b) < 2e-5), (r.item_id, r.strategy, r.k, name, a, b)
        seen += 1
    assert seen == 12 * len(asked)


def test_prototype_feature_rows(spark, data):
    rows = {r.item_id: r for r in QUERIES["prototype_feature_rows"](spark, SF).collect()}
    assert set(rows) == {r.item_id for r in data["benchmark"]}
    hybrid = {(r.item_id, r["rank"]): (r.score, r.doc_id) for r in QUERIES["linear_hybrid_topk"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in data["documents"]}
    token = re.compile(r"[a-z0-9_./:+#-]+")
    for item in data["benchmark"]:
        r, n = rows[item.item_id], sum(i == item.item_id for i, _ in hybrid)
        scores = [hybrid[item.item_id, k][0] for k in range(1, n + 1)]
        texts = [docs[hybrid[item.item_id, k][1]] for k in range(1, n + 1)]
        own = set(token.findall(item.text.lower()))
        shares = [len(own & set(token.findall(t.lower()))) / len(own) for t in texts]
        second = scores[1] if n > 1 else 0.0
        want = {
            "top_hybrid": scores[0], "mean_hybrid": sum(scores) / n, "score_gap": scores[0] - second, "score_gap_ratio": (scores[0] - second) / (abs(scores[0]) + 1e-6),
            "top_lexical_overlap": shares[0], "mean_lexical_overlap": sum(shares) / n, "lexical_overlap": len(own & set(token.findall("\n".join(texts).lower()))) / len(own),
            "question_len": len(item.text.split()), "retrieved_chars": len("\n".join(texts)),
        }
        assert all(abs(r[k] - v) < 2e-5 for k, v in want.items()), (item.item_id, r, want)


def test_rendered_premises(spark):
    rows = QUERIES["rendered_premises"](spark, SF).collect()
    assert rows and all(len(L.whitespace.encode(r.premise)) <= 45 and r.premise.startswith("[Retrieved chunk rank 1]\n") for r in rows)


def test_premises_keep_head_and_tail_in_equal_shares():
    units = [(1, " ".join(f"a{i}" for i in range(100))), (2, "short one")]
    claim = "a claim of five words"
    premise = L.render_premise(claim, units, 60)
    body = premise.split("\n\n")[0].split("\n")[1].split()
    assert body[0] == "a0" and body[-1] == "a99" and 2 <= len(body) < 100 and premise.endswith("short one")
    assert len(L.whitespace.encode(premise)) + 5 + 3 <= 60
    assert L.head_tail(list(range(9)), 4) == [0, 1, 7, 8] and L.head_tail(list(range(9)), 5) == [0, 1, 2, 7, 8] and L.head_tail([1], 3) == [1]
    for bad in (lambda: L.render_premise("x " * 60, units, 60), lambda: L.render_premise("x", [], 60)):
        with pytest.raises(ValueError):
            bad()


def test_assembled_prompts(spark, data):
    docs = {str(r.doc_id): r.text for r in data["documents"]}
    rows = QUERIES["assembled_prompts"](spark, SF).collect()
    assert len(rows) == len(data["benchmark"])
    for r in rows:
        assert r.prompt_tokens <= 600 and r.whole_chunks + (r.cut_chunk is not None) == len(r.visible) and r.left_out + len(r.visible) <= 10
        if r.cut_chunk is not None:
            assert r.visible[-1] == r.cut_chunk and 0 < r.cut_to < r.cut_from == len(L.whitespace.encode(docs[r.cut_chunk]))


def test_a_prompt_takes_the_longest_prefix_that_fits():
    template, chunks = "Q {question}\n{context}", [(1, "a", "one two three"), (2, "b", " ".join(f"w{i}" for i in range(50))), (3, "c", "never")]
    got = L.assemble("why", chunks, 30, template, L.whitespace)
    size = lambda n: len(L.whitespace.encode(L.fill_template(template, "why", "[CHUNK 1]\none two three\n\n[CHUNK 2]\n" + " ".join(f"w{i}" for i in range(n)))))
    assert got["visible"] == ["a", "b"] and got["cut_to"] == max(n for n in range(51) if size(n) <= 30) and got["left_out"] == 1 and got["prompt_tokens"] <= 30
    assert got["context_sha256"] == hashlib.sha256(got["context"].encode()).hexdigest()
    with pytest.raises(ValueError):
        L.fill_template("{question}", "a", "b")
    with pytest.raises(ValueError):
        L.assemble("why", chunks, 3, template, L.whitespace)


def test_cosine_claim_support(spark):
    claims, asked = defaultdict(set), {}
    for r in QUERIES["claim_segments"](spark, SF).collect():
        claims[r.response_id].add(r.text)
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for (conv, turn), r in turns.items():
        if r.role == "assistant":
            before = turns.get((conv, turn - 1))
            asked[f"{conv}-{turn}"] = before.text if before and before.role == "user" else None
    words = lambda t: set(re.findall(r"\w+", t.lower()))

    def support(claim, question):
        a, b = words(claim), words(question or "")
        return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0

    for r in QUERIES["cosine_claim_support"](spark, SF).collect():
        low = sum(support(c, asked[r.response_id]) < 0.42 for c in claims[r.response_id])
        n = len(claims[r.response_id])
        assert (r.claims, r.unsupported) == (n, low) and abs(r.unsupported_rate - (low / n if n else 0.0)) < 1e-6


def test_answered_questions(spark):
    for r in QUERIES["answered_questions"](spark, SF).collect():
        assert r.decision in ("answer", "abstain") and (r.rouge_l is None) == (r.decision != "answer")
        assert r.source in ("policy", "generated", "extractive_fallback", "fallback_no_supported_sentence") and 0 <= r.p <= 1


def test_component_manifest(spark):
    rows = QUERIES["component_manifest"](spark, SF).collect()
    assigned = QUERIES["assignment_manifest"](spark, SF).collect()
    members = {r.component: json.loads(r.member_question_ids_json) for r in rows}
    assert sorted(q for m in members.values() for q in m) == sorted(r.question_id for r in assigned)
    assert all(r.component_size == len(members[r.component]) == r.answerable_count + r.impossible_count for r in rows)
    files = [f for r in rows for f in json.loads(r.shared_gold_filenames_json)]
    assert len(files) == len(set(files)) and len({r.component_sha256 for r in rows}) == len(rows)


def test_assignment_manifest(spark):
    rows = QUERIES["assignment_manifest"](spark, SF).collect()
    assert {r.provenance_partition for r in rows} == {"TRAIN"}
    assert all((r.reference_status == "not_applicable_impossible") == r.is_impossible for r in rows)
    split = defaultdict(set)
    for r in rows:
        split[r.component].add(r.split)
    assert all(len(s) == 1 for s in split.values())


def test_response_manifest(spark):
    rows = QUERIES["response_manifest"](spark, SF).collect()
    ids = [r.response_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (len(i), i)) and all(r.has_unsupported_span == (r.label_count > 0) for r in rows)
    assert all(json.loads(r.label_types_json) == sorted(json.loads(r.label_types_json)) for r in rows)


def test_classifier_table(spark):
    rows = {(r.split, r.metric): r for r in QUERIES["classifier_table"](spark, SF).collect()}
    points = {(r.split): r for r in QUERIES["model_metric_rows"](spark, SF).collect()}
    assert len(rows) == 16
    for (split, metric), r in rows.items():
        assert r.value == pytest.approx(points[split][metric], abs=1e-6)
        if metric in ("brier", "accuracy"):
            assert r.lower <= r.upper
        else:
            assert r.lower is None


def test_risk_table(spark):
    rows = QUERIES["risk_table"](spark, SF).collect()
    assert Counter(r.split for r in rows) == {"validation": 5, "test": 5} and {r.point for r in rows} == {"AURC", "5%", "10%", "14%", "20%"}


def test_association_table(spark):
    rows = QUERIES["association_table"](spark, SF).collect()
    assert len(rows) == 16
    for r in rows:
        assert r.n1 > 0 and r.n0 > 0 and (r.p is None or 0 <= r.p <= 1) and (r.cliffs_delta is None) == (r.kind == "binary")


def test_impossible_sensitivity(spark):
    r = QUERIES["impossible_sensitivity"](spark, SF).first()
    assert r.rows > 0 and 0 <= r.mean_probability <= 1 and r.accuracy == pytest.approx(1 - r.predicted_sufficient / r.rows)
