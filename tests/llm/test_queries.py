"""The registered queries: their columns, and SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from ragstone.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op4": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6": ["doc_id", "class_id"],
    "op7": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8": ["doc_id", "size", "source_size", "target", "taken"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


def test_all_ten_are_there():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = COLUMNS[name.split("_")[0]]
    assert df.columns[: len(want)] == want
    if name.startswith("op2"):
        assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sf, name):
    connection = duckdb.connect()
    for p in Path(sf).iterdir():
        connection.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    want = [tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in sorted(names)) for r in QUERIES[name](spark, sf).collect()]
    assert sorted(got) == sorted(want)
