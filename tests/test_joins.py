from tabeval.operators.joins import lookup


def test_lookup_broadcasts_only_a_counted_small_table(spark):
    rows = spark.range(1000).selectExpr("id % 5 AS k", "id AS v")
    table = rows.groupBy("k").count()

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    small, large = lookup(rows, table, ["k"]), lookup(rows, table, ["k"], limit=3)
    assert hinted(small) and not hinted(large)
    assert small.count() == large.count() == 1000
