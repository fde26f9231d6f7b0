import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from ragstone.llm import mixing, secrets
from ragstone.llm.packing import default_config, token_ids

from .test_neardup import brute as classes


def test_stages_take_effect_and_run_is_their_composition(spark, corpus, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
            docs = docs.cache()
        seen[name] = docs.collect()
    kept = {r.doc_id: r.text for r in seen["quality rules"]}
    assert 0 < len(kept) < len(corpus) and all(corpus[i] == t for i, t in kept.items())
    single = {r.doc_id: r.text for r in seen["near duplicates"]}
    assert set(single) == set(classes(kept).values())
    clean = {r.doc_id: r.text for r in seen["secret scan"]}
    config = secrets.default_config()
    encode = secrets.encoding(config.ranks_path, config.pattern).encode_ordinary
    for i, t in single.items():
        spans = secrets.find_spans(t, encode, config)
        assert clean[i] == secrets.masked(t, spans, config.mask) and not (spans and clean[i] == t)
    copies = Counter(r.doc_id for r in seen["source mixing"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    report = {r.doc_id: r for r in mixing.mix_report(spark.createDataFrame([(r.doc_id, r.source, r.text) for r in seen["secret scan"]], "doc_id long, source string, text string")).collect()}
    assert all(copies[i] * size(t) == report[i].taken for i, t in clean.items())
    pack = default_config()
    tokens = {i: len(token_ids(clean[i], pack)) for i in copies}
    per = defaultdict(int)
    for r in seen["packing"]:
        per[r.doc_id] += r.length
    assert per == {i: n * tokens[i] for i, n in copies.items()}
    assert sorted(map(tuple, C.run(spark, sf).collect())) == sorted(map(tuple, seen["packing"]))


def test_odd_and_empty_tables_go_through(spark, odd, none, sf):
    text = " ".join(f"Some m{i * i} words q{i} stand here, number v{i + 7}." for i in range(40)).replace("1", "ab").replace("3", "cd")
    more = [(None, text), (None, text + " And more."), (20, text.replace("words", "things")), (21, text), (21, text), (22, None)]
    rows = spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, 4, [5], "x", 6) for i, t in more], odd.schema)
    for docs in (odd.unionByName(rows), none):
        for name, stage in C.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            if name != C.STAGES[-1][0]:
                assert docs.columns == before.columns
                docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name == "near duplicates" and before is not none and before.count():
                # Two texts without an id, alike to that of 21: the class keeps its smallest id; the changed one stays.
                assert sorted(r.doc_id for r in docs.collect() if r.text.startswith("Some m0")) == [20, 21]
        left = docs.collect()
        assert not left if before.count() == 0 else all(r.length > 0 for r in left)
