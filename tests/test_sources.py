import hashlib
import json
import zipfile

import pytest

from ragstone.sources import readers, sinks
from ragstone.streaming import keyed

GOOD = {"id": "x_Q1", "question": "q", "answer": "a", "is_impossible": False, "contexts": [{"filename": "f", "text": "t"}]}


def put(path, rows, lines=True):
    path.write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps(rows))
    return str(path)


def test_json_is_strict(spark, tmp_path):
    assert readers.read_json(spark, put(tmp_path / "a.json", [GOOD], False), readers.QUESTION, array=True).first().contexts[0].text == "t"
    for i, odd in enumerate(({**GOOD, "extra": 1}, {k: v for k, v in GOOD.items() if k != "answer"})):
        with pytest.raises(readers.SchemaError):
            readers.read_json(spark, put(tmp_path / f"b{i}.jsonl", [odd]), readers.QUESTION)
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        readers.read_json(spark, put(tmp_path / "c.jsonl", [{**GOOD, "is_impossible": 0}]), readers.QUESTION).collect()


def test_csv_header_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, None, [1, 2]), (1, 'a,"b"\nc', None)], "k int, t string, l array<int>")
    sinks.write_csv(df, str(tmp_path / "out"), ["k", "t", "l"], ["k"])
    back = readers.read_csv(spark, str(tmp_path / "out"), "k int, t string, l string")
    assert sorted(map(tuple, back.collect())) == [(1, 'a,"b"\nc', None), (2, None, "[1,2]")]
    (tmp_path / "bom.csv").write_bytes("﻿k,t\n1,x\n".encode())
    assert readers.csv_columns(spark, str(tmp_path / "bom.csv")) == ["k", "t"]
    with pytest.raises(readers.SchemaError):
        readers.read_csv(spark, str(tmp_path / "bom.csv"), "t string, k int")
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "no"), ["k", "t"], ["k"])


def test_archives(spark, tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a/x.txt", "one")
        z.writestr("b/x.txt", "one")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x", "y")
    files = readers.read_zip(spark, str(good))
    assert sorted(r.path for r in files.collect()) == ["a/x.txt", "b/x.txt"]
    assert {r.kind: r.groups for r in readers.duplicate_groups(files).collect()} == {"basename": 1, "content": 1}
    with pytest.raises(Exception, match="unsafe"):
        readers.read_zip(spark, str(bad)).collect()
    with pytest.raises(Exception, match="hash"):
        readers.read_zip(spark, str(good), "0" * 64).collect()
    assert readers.verified(spark, str(good), hashlib.sha256(good.read_bytes()).hexdigest()).first().ok
    with pytest.raises(readers.SchemaError):
        readers.read_folder(spark, str(tmp_path), expected=5)
    assert readers.read_folder(spark, str(tmp_path), expected=2).count() == 2


def test_canonical_and_immutable_writes(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string")
    one = sinks.write_parquet(df, str(tmp_path / "a"), ["k", "v"], ["k"], files=2)
    two = sinks.write_parquet(df.repartition(5), str(tmp_path / "b"), ["k", "v"], ["k"], files=1)
    assert one == two and one["rows"] == 3
    assert sinks.write_immutable(df, str(tmp_path / "c")) == "written" and sinks.write_immutable(df.repartition(2), str(tmp_path / "c")) == "same"
    with pytest.raises(sinks.ImmutableError):
        sinks.write_immutable(df.limit(2), str(tmp_path / "c"))


def test_keyed_appends_resume(spark, tmp_path):
    path, df = str(tmp_path / "log"), spark.createDataFrame([(i, i * i) for i in range(5)], "k int, v int")
    assert keyed.append(df.limit(2), path, ["k"], "c") == 2
    assert keyed.append(df, path, ["k"], "c") == 3 and keyed.append(df, path, ["k"], "c") == 0
    with pytest.raises(keyed.StaleError):
        keyed.kept(spark, path, ["k"], "other")
    df.withColumn("v", df.v + 1).selectExpr("k", "v", "'c' as config_sha256").write.mode("append").parquet(path)
    with pytest.raises(keyed.StaleError):
        keyed.kept(spark, path, ["k"], "c")


def test_keyed_stream_takes_each_key_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    df.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(source)
        keyed.append_stream(stream, path, ["k"], "c", str(tmp_path / "cp")).awaitTermination()
        df.filter("k = 2").write.mode("append").parquet(source)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]


def test_missing_fields_become_null(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert readers.projected(df, "b string, a long").first() == (None, 1)
