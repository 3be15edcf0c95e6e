import datetime as dt

from pagemill.streaming.changes import captured_stream, changes


def test_changes(spark, tmp_path):
    at = [dt.datetime(2031, 1, k) for k in (1, 2, 3, 4)]
    rows = [("u", "a", at[0]), ("u", "a", at[1]), ("u", "b", at[2]), ("v", "a", at[3]), ("v", None, at[3])]
    spark.createDataFrame(rows, "url string, content_hash string, loaded_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, content_hash string, loaded_at timestamp").parquet(str(tmp_path / "in"))
    query = changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = sorted(tuple(r) for r in spark.table("changes").collect())
    assert found == [("u", "a", None, "new"), ("u", "b", "a", "changed"), ("v", "a", None, "new")]


def test_extractor_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "https://s.example/", "<h1>Hi there</h1>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id bigint, url string, html string").parquet(str(tmp_path / "in"))
    query = captured_stream(stream).select("page_id", "total_words", "category").writeStream.format("memory").queryName("captured").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert [tuple(r) for r in spark.table("captured").collect()] == [(1, 2, "home")]
