import hashlib
import json
import xml.dom.minidom

import pytest

from ragstone.operators import integrity as I
from ragstone.operators import reports as T
from ragstone.sources import readers as R
from ragstone.sources import sinks as K


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def source(**more):
    return {"source_id": "s1", "task_type": "QA", "source": "x", "source_info": {"question": "q", "passages": "p"}, "prompt": "p"} | more


def response(**more):
    label = {"start": 0, "end": 2, "text": "ab", "meta": None, "label_type": "conflict", "implicit_true": False, "due_to_null": False}
    return {"id": "r1", "source_id": "s1", "model": "m", "temperature": 0.5, "labels": [label], "split": "train", "quality": "good", "response": "abc"} | more


def test_sources_need_their_parts(spark, tmp_path):
    assert R.read_sources(spark, lines(tmp_path / "a.jsonl", [source(), source(source_id="s2", task_type="Other")])).count() == 2
    bad = R.read_sources(spark, lines(tmp_path / "b.jsonl", [source(), source(source_id="s2", source_info={"question": None, "passages": "p"})]))
    with pytest.raises(Exception, match="lacks its question"):
        bad.collect()
    with pytest.raises(Exception, match="lacks a text"):
        R.read_sources(spark, lines(tmp_path / "c.jsonl", [source(), source(prompt=None)])).collect()


def test_responses_need_whole_labels(spark, tmp_path):
    assert R.read_responses(spark, lines(tmp_path / "a.jsonl", [response(), response(id="r2", labels=[])])).count() == 2
    label = {**response()["labels"][0], "start": None}
    with pytest.raises(Exception, match="incomplete label"):
        R.read_responses(spark, lines(tmp_path / "b.jsonl", [response(), response(id="r2", labels=[label])])).collect()


def manifest(path, rows):
    path.write_text("doc_id,filename,raw_sha256,normalized_sha256,n_chars,placeholder_count\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_manifests_are_typed_and_unique(spark, tmp_path):
    h = hashlib.sha256(b"x").hexdigest()
    good = R.read_manifest(spark, manifest(tmp_path / "a.csv", [("d1", "f1", h, h, 3, 0), ("d2", "f2", h, h, 4, 1)]))
    assert [(r.doc_id, r.n_chars) for r in good.orderBy("doc_id").collect()] == [("d1", 3), ("d2", 4)]
    for name, rows in (("b", [("d1", "f1", h, h, 3, 0), ("d1", "f2", h, h, 4, 1)]), ("c", [("d1", "f1", h, h.upper(), 3, 0)])):
        with pytest.raises(Exception, match="repeated|SHA-256"):
            R.read_manifest(spark, manifest(tmp_path / f"{name}.csv", rows)).collect()


def test_download_is_checked_and_atomic(tmp_path):
    origin, place = tmp_path / "origin.bin", tmp_path / "deep" / "copy.bin"
    origin.write_bytes(b"content")
    digest = hashlib.sha256(b"content").hexdigest()
    assert R.download(origin.as_uri(), str(place), digest) == "fetched" and R.download("file:///nowhere", str(place), digest) == "kept"
    with pytest.raises(ValueError, match="another hash"):
        R.download(origin.as_uri(), str(place), "0" * 64)
    with pytest.raises(ValueError, match="another hash"):
        R.download(origin.as_uri(), str(tmp_path / "other.bin"), "0" * 64)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deep", "origin.bin"]


def test_artifacts_are_written_once(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert K.write_json(spark, path, {"b": 1, "a": ["é"]}) == "written" and K.write_json(spark, path, {"a": ["é"], "b": 1}) == "same"
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": ["é"], "b": 1} and (tmp_path / "a.json").read_text().endswith("}\n")
    with pytest.raises(K.ImmutableError):
        K.write_json(spark, path, {"b": 2})
    with pytest.raises(ValueError):
        K.write_json(spark, str(tmp_path / "b.json"), float("nan"))


def test_figures_are_svg(spark, tmp_path):
    series = [
        {"name": "risk & coverage", "kind": "step", "points": [(0.1, 0.5), (0.4, 0.2), (1.0, None)]},
        {"name": "models", "kind": "dots", "points": [(0.2, 0.3, 0.1, 0.4)]},
        {"name": "n", "kind": "bars", "points": [(0.5, 1.0)]},
    ]
    text = T.svg(series, "A <title>", "x", "y")
    assert xml.dom.minidom.parseString(text).documentElement.tagName == "svg" and text.count("<circle") == 1 and text.count("<rect") == 1
    assert xml.dom.minidom.parseString(T.svg([{"name": "c", "kind": "bars", "points": [("a", 1.0), ("b", 2.0)]}], "t", "x", "y"))
    assert xml.dom.minidom.parseString(T.svg([], "t", "x", "y")) and K.write_text(spark, str(tmp_path / "f.svg"), text) == "written"


def test_frozen_inputs_and_configurations(spark, tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Config:
        seed: int
        name: str

    (tmp_path / "in.txt").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    there, gone = str(tmp_path / "in.txt"), str(tmp_path / "gone.txt")
    assert {r.path: r.ok for r in I.frozen_inputs(spark, {there: digest, gone: digest}).collect()} == {there: True, gone: False}
    (tmp_path / "c.json").write_text('{"seed": 3, "name": "x"}')
    assert I.load_config(Config, tmp_path / "c.json", constants={"seed": 3}) == Config(3, "x")
    for kwargs in ({"sha256": "0"}, {"constants": {"seed": 4}}):
        with pytest.raises(ValueError):
            I.load_config(Config, tmp_path / "c.json", **kwargs)
    (tmp_path / "d.json").write_text('{"seed": 3}')
    with pytest.raises(ValueError, match="match"):
        I.load_config(Config, tmp_path / "d.json")
    assert I.environment()["packages"]["pyspark"] and I.environment(("nowhere",))["packages"] == {"nowhere": None}


def test_report_text(spark):
    tests = spark.createDataFrame([("k10-k5", "risk", 0.1, 0.01), ("a", "b", None, None)], "comparison string, metric string, difference double, p_holm double")
    assert T.result_text(tests) == "- k10-k5, risk: difference 0.100000, adjusted p 0.010000, rejected at 0.05.\n- a, b: difference NA, adjusted p NA, undefined at 0.05.\n"
    assert T.question_matrix([("Does it?", "risk", "T|1")]).splitlines()[-1] == "| Does it? | risk | T\\|1 |"
