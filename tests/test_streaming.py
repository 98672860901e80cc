from arcweft.streaming.edges import append_relationships, stream_relationships


def test_a_stream_of_relationships(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "rel_id string, src string, dst string, w double"
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    for k, rows in enumerate(([("r1", "a", "b", 1.0), ("r1", "a", "b", 1.0), ("r2", "a", "z", 2.0)], [("r3", "b", "a", 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        append_relationships(stream_relationships(spark, source, schema), nodes, target, state).awaitTermination(60)
        assert spark.read.parquet(f"{target}/accepted").count() == k + 1
    assert [r.rel_id for r in spark.read.parquet(f"{target}/refused").collect()] == ["r2"]
