from ledgerloom.streaming.winners import running_winners, upsert_winners, windowed_counts


def test_running_winners_end_as_the_batch(spark, small_data, tmp_path):
    table = spark.read.parquet(f"{small_data}/candidates.parquet")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_winners(stream).writeStream.outputMode("complete").format("memory").queryName("winners").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("winners").exceptAll(running_winners(table)).count() == 0
    job = upsert_winners(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    job.awaitTermination(120)
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch"))
    assert spark.read.parquet(str(tmp_path / "out" / last)).count() == running_winners(table).count()


def test_windows_leave_late_records_out(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)]
    late = [("2024-01-01 00:03:00", "a", 8.0), ("2024-01-01 02:00:00", "a", 16.0)]
    schema = "at string, kind string, value double"
    stamp = "CAST(at AS TIMESTAMP) AS ts"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).selectExpr(stamp, "kind", "value").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(path)
    query = windowed_counts(stream, "ts", "kind").writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    spark.createDataFrame(late, schema).selectExpr(stamp, "kind", "value").coalesce(1).write.mode("append").parquet(path)
    query.processAllAvailable()
    query.stop()
    first = spark.table("windows").orderBy("begin").first()
    assert (first.events, first.value) == (2, 3.0)
