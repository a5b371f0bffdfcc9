import random

from pyspark.sql import functions as F

from paperloom.operators import skew


def hot_rows(spark, n=3000):
    """A third of the rows share one key; many share one order value."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", rng.randrange(5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, v int").repartition(7)


def test_number_rows_equals_a_plain_sort(spark):
    rows, df = hot_rows(spark)
    expected = {}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        expected.update({r[0]: i for i, r in enumerate(group, 1)})
    numbered = skew.number_rows(df, ["key"], [F.asc("v"), F.asc("id")])
    assert {r["id"]: r["rn"] for r in numbered.collect()} == expected


def test_number_rows_without_keys(spark):
    rows, df = hot_rows(spark, 500)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    numbered = skew.number_rows(df, [], [F.asc("v"), F.asc("id")]).orderBy("rn").collect()
    assert [r["id"] for r in numbered] == order
    assert [r["rn"] for r in numbered] == list(range(1, 501))


def test_hot_values(spark):
    _, df = hot_rows(spark)
    assert skew.hot_values(df, "key", share=0.1, min_rows=10) == ["hot"]
    assert skew.hot_values(df, "key") == []
    assert skew.hot_values(df.where("false"), "key") == []


def test_salted_joins_equal_the_plain_join(spark):
    _, df = hot_rows(spark)
    right = df.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k7'")
    hot_table = skew.top_keys(right, ["key"], "n")
    for how in ("inner", "left"):
        plain = sorted(df.join(right, "key", how).select("id", "key", "n").collect())
        for hot in (hot_table, F.col("key") == "hot"):
            salted = skew.lookup_join(df, right, ["key"], F.col("id"), hot, how)
            assert sorted(salted.select("id", "key", "n").collect()) == plain


def test_row_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_values", lambda df, key: ["hot"])
    _, df = hot_rows(spark)
    right = df.groupBy("key").agg(F.count("*").alias("n"))
    found = skew.row_lookup(df, right, "key", F.col("id"))
    assert found.where("key = 'hot'").agg(F.count("*"), F.min("n")).head() == (1000, 1000)


def test_number_rows_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 4), (3, "a", 1), (4, "a", None), (5, None, 6)], "id bigint, key string, v int")
    found = {r["id"]: r["rn"] for r in skew.number_rows(df, ["key"], [F.asc("v"), F.asc("id")]).collect()}
    assert found == {2: 1, 1: 2, 5: 3, 4: 1, 3: 2}


def test_salts_follow_the_rows_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 20)
    _, df = hot_rows(spark)
    found = skew.hot_values(df, "key", min_rows=20)
    assert found[0] == "hot" and found.most == 1000
    right = df.groupBy("key").agg(F.count("*").alias("n"))
    monkeypatch.setattr(skew, "hot_values", lambda df, key: found)
    assert skew.row_lookup(df, right, "key", F.col("id")).count() == 3000
