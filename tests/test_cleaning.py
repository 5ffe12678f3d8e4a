import pytest
from pyspark.sql import functions as F

from priorform.operators import cleaning, encoding

NAN = float("nan")


def test_column_types_by_values(spark):
    rows = [(1, "1.5", "a", 0, None, True, "1d"), (2, "2", "b", 1, 3.0, False, "2"), (3, None, "a", 0, NAN, True, "3"), (4, "4", "c", 1, 4.0, False, "4")]
    df = spark.createDataFrame(rows, "n int, numtext string, text string, two int, gap double, r boolean, suffix string")
    cats, conts, response_cat = cleaning.column_types(df, ["n", "numtext", "text", "two", "gap", "suffix"], "r")
    assert conts == ["n", "numtext", "gap"] and cats == ["text", "two", "suffix"] and response_cat
    # Two values and a missing one are three; one value and a missing one are two.
    more = spark.createDataFrame([(0, 5, 1.0), (1, None, 1.0), (None, 5, 1.0)], "a int, b int, c double")
    cats, conts, response_cat = cleaning.column_types(more, ["a", "b"], "c")
    assert conts == ["a"] and cats == ["b"] and not response_cat


def test_two_value_rule_ignores_missing(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (None, 3, 1)], "a int, b int, c int")
    assert cleaning.two_value_types(df, ["a", "b", "c"]) == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["yes", "No", "TRUE", None], [1.0, 0.0, 1.0, None]),
        (["1", "0.5", None], [1.0, 0.5, None]),
        (["y", "maybe"], None),
    ],
)
def test_response_text(spark, texts, expected):
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    c = cleaning.numeric_response(df, "r")
    assert (c is None and expected is None) or [r[0] for r in df.select(c).collect()] == expected


def test_two_value_rule_reads_no_text_as_a_number(spark, monkeypatch):
    df = spark.createDataFrame([("x",), ("1",), (None,)], "c string")

    def refused(text):
        raise AssertionError("texts were parsed")

    monkeypatch.setattr(cleaning, "parsed_double", refused)
    assert cleaning.two_value_types(df, ["c"]) == {"c": False}


def test_blank_and_drop(spark):
    df = spark.createDataFrame([("", 1.0), ("None", 2.0), ("R", NAN), ("L", 3.0), (None, 1.0)], "h string, x double")
    clean = cleaning.blank_to_null(df, ["h"])
    assert [r["h"] for r in clean.collect()] == [None, None, "R", "L", None]
    assert [tuple(r) for r in cleaning.drop_missing(clean).collect()] == [("L", 3.0)]
    assert cleaning.drop_missing(clean, ["x"]).count() == 4


def test_one_hot_drops_the_first_level_and_null_is_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "k int, c string")
    got = encoding.one_hot(df, "c").orderBy("k")
    assert got.columns == ["k", "c_b", "c_c"]
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]


def test_many_levels(spark):
    df = spark.createDataFrame([(i, f"v{i:04d}" if i else None) for i in range(1501)], "k int, c string")
    wide = encoding.one_hot(df, "c")
    assert len(wide.columns) == 1500 and encoding.levels(df, "c")[-1] == "v1500"
    got = {r["k"]: r["c_vector"] for r in encoding.one_hot_vector(df, "c").select("k", "c_vector").collect()}
    assert len(got) == 1501 and got[0].numNonzeros() == got[1].numNonzeros() == 0
    assert got[2].size == 1499 and got[2][0] == 1.0 and got[1500][1498] == 1.0


def test_label_encode(spark):
    df = spark.createDataFrame([(1, "b", True, 1), (2, "a", False, 0), (3, "b", True, 1), (4, None, None, 0)], "k int, c string, f boolean, z int")
    codes = {r["c"]: r["bool_c"] for r in encoding.label_encode(df, "c", order_by="k").collect()}
    assert codes == {"b": 0, "a": 1, None: None}
    assert {r["c"]: r["bool_c"] for r in encoding.label_encode(df, "c").collect()} == {"a": 0, "b": 1, None: None}
    assert [r["bool_f"] for r in encoding.label_encode(df, "f").orderBy("k").collect()] == [1, 0, 1, None]
    assert [r["bool_z"] for r in encoding.label_encode(df, "z").orderBy("k").collect()] == [1, 0, 1, 0]


def test_hashed_choice_survives_repartitioning(spark):
    df = spark.range(500)
    pick = encoding.hashed_choice(["id"], ["a", "b", "c"], seed=5).alias("c")
    one = {tuple(r) for r in df.select("id", pick).collect()}
    two = {tuple(r) for r in df.repartition(7).select("id", pick).collect()}
    assert one == two and {c for _, c in one} == {"a", "b", "c"}


def test_splits(spark):
    df = spark.createDataFrame([("2009-05-01",), ("2011-05-01",), ("2012-05-01",)], "d string").select(F.to_date("d").alias("d"))
    train, test = encoding.time_split(df, "d", 2011)
    assert (train.count(), test.count()) == (1, 1)
    train, test = encoding.time_split(df, "d", 2011, "not_equal")
    assert (train.count(), test.count()) == (2, 1)
    with pytest.raises(ValueError):
        encoding.split_label("d", 2011, "random")
    marked = encoding.nth_row_flag(spark.range(25), ["id"], 10)
    assert sorted(r["id"] for r in marked.where("is_test = 1").collect()) == [0, 10, 20]
