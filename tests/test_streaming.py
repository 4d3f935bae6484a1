import json

from quoin.streaming.requests import replies


def test_stream_of_requests(spark, tmp_path):
    lines = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/call", "params": {"name": "convert_pdf", "arguments": {"path": "x"}}}, {"id": 3, "method": "tools/call", "params": {"name": "other"}}, {"method": "nothing"}, {"id": 4, "method": "nothing"}, {"method": "notifications/initialized"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n\n")
    results = spark.createDataFrame([("x", "# X\n", None)], "path string, md string, error string")
    stream = replies(spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line"), results)
    q = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r.id, r.kind) for r in spark.table("answers").collect()} == {("1", "version"), ("2", "text"), ("3", "-32602"), ("4", "-32601")}
