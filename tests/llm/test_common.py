from pyspark.sql import functions as F

from ragstone.llm import common as C


def test_staged_tables_are_read_back_and_dropped(spark):
    C.drop_staged(spark)
    df = C.staged(spark.range(5), "test")
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:")
    assert C.drop_staged(spark) == 1 and C.drop_staged(spark) == 0
    empty = C.staged(spark.range(0), "test")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_binary_search(spark):
    df = spark.createDataFrame([([1, 3, 3, 9], x) for x in (0, 1, 3, 8, 9, 10)], "a array<long>, x long")
    assert [r[0] for r in df.select(C.count_at_most(F.col("a"), F.col("x"))).collect()] == [0, 1, 3, 3, 4, 4]
    assert spark.range(1).select(C.count_at_most(C.longs([]), F.lit(5))).first()[0] == 0


def test_words(spark):
    df = spark.createDataFrame([(" a\tb c\x0b d\n",), ("",), (" ",)], "t string")
    assert [r[0] for r in df.select(C.words_of(F.col("t"))).collect()] == [["a", "b c", "d"], [], []]


def test_what_a_result_was_made_of_is_dropped(spark):
    C.drop_staged(spark)
    first = C.staged(spark.range(3), "kept")
    made = C.settled(spark, lambda: C.staged(C.staged(spark.range(7), "part"), "part"), "whole")
    assert made.count() == 7 and first.count() == 3 and C.drop_staged(spark) == 2
