import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus():
    """doc_id -> text of the smallest supplied table."""
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.fixture(scope="session")
def sf():
    return SF


#: Nulls, empties, ties, repeats, and extra columns whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, h long, w long, starts array<int>, sketch string, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents that no operator may stumble over."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [
        (1, word), (2, word), (2, word), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (None, word), (None, None),
        (7, ("x" * 50 + " ") * 20_000), (8, "~" * 300_000), (9, "déjà vu, ß und 😀 " * 30), (10, word.upper()),
    ]
    rows = [(i, t, None, None if i == 3 else "s", None, 1, 2, 3, 4, [5], "x", 6) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
