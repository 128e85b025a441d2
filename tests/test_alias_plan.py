"""Aliases meet texts without a broadcast of the texts' runs of words."""

from ledgerline.operators import entities as en


def test_runs_are_not_broadcast(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Shares of Blue Ring rose"), (2, "hp"), (3, "we like hp"), (4, "blue"), (5, None)], "id int, text string")
    texts.write.parquet(f"{tmp_path}/texts")
    aliases = spark.createDataFrame([("blue ring", "BR"), ("blue", "B"), ("hp", "H")], "alias string, ticker string")
    got = en.resolve_alias(spark.read.parquet(f"{tmp_path}/texts"), aliases, "id", "text")
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    # A short alias only counts if it is the whole text.
    assert {tuple(r) for r in got.collect()} == {(1, "BR", "blue ring"), (2, "H", "hp"), (4, "B", "blue")}
