from tarnline.streaming.ingest import ingest_stream, rates_by_window

SCHEMA = "namespace string, id string, ingest_id long, text string"


def test_incremental_ingest_keeps_the_last_row(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [[("n", "a", 1, "x"), ("m", "a", 2, "y")], [("n", "a", 3, "z"), ("n", "b", 4, None)]]
    for batch in rows:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
        query = ingest_stream(spark, source, SCHEMA, table, str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.namespace, r.id, r.ingest_id, r.text) for r in spark.read.parquet(table).collect()}
    assert got == {("n", "a", 3, "z"), ("m", "a", 2, "y"), ("n", "b", 4, None)}


def test_windows_with_late_rows(spark, tmp_path):
    source = str(tmp_path / "ev")
    schema = "ts timestamp_ntz, kind string, value double"
    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:01:00' AS ts, 'a' AS kind, 1.0D AS value UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 00:02:00', 'a', 2.0D").write.parquet(source)
    stream = rates_by_window(spark.readStream.schema(schema).parquet(source), "ts", "10 minutes", "5 minutes", "kind", "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.kind, r.n, r.total) for r in spark.sql("SELECT * FROM rates").collect()] == [("a", 2, 3.0)]
