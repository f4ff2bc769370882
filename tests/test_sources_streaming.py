import datetime as dt
import json

from palimpsest.operators import log
from palimpsest.sources import readers
from palimpsest.streaming import ingest


def test_log_round_trip(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 2, 3, 4, 5), "user", "a | b"), (2, dt.datetime(2024, 2, 2), "agent", "你好")]
    df = spark.createDataFrame(rows, "msg_id int, ts timestamp_ntz, sender string, text string")
    readers.export_text(df, str(tmp_path / "out"))
    back = readers.log_text(spark, str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.ts, r.sender, r.text) for r in back] == [r[1:] for r in rows]


def test_malformed_lines_are_told(spark, tmp_path):
    (tmp_path / "log.txt").write_text("2024-01-01 00:00:00 | user | hi\nbroken | line\n\n")
    assert readers.log_text(spark, str(tmp_path / "log.txt")).count() == 1
    assert readers.malformed(spark, str(tmp_path / "log.txt")).count() == 2


def test_chat_exports(spark, tmp_path):
    node = lambda t, role, parts: {"create_time": t, "message": {"author": {"role": role}, "content": {"parts": parts}}}
    (tmp_path / "a.json").write_text(json.dumps({"mapping": {"x": node(2.0, "assistant", ["yes"]), "y": node(1.0, "user", ["he", {"image": 1}, "llo"]), "z": {"message": None}}}))
    assert [(r.sender, r.text) for r in readers.read_any(spark, str(tmp_path / "a.json"), "chatgpt").collect()] == [("user", "hello"), ("agent", "yes")]
    (tmp_path / "b.json").write_text(json.dumps({"chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "a"}]}))
    assert [(r.sender, r.text) for r in readers.read_any(spark, str(tmp_path / "b.json"), "claude").orderBy("pos").collect()] == [("user", "q"), ("agent", "a")]


def test_json_lines_drop_bad_rows(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"ts": "t", "decision": "x", "offset": 5}\n{bad\n')
    assert [r.offset for r in readers.json_lines(spark, str(tmp_path / "d.jsonl")).collect()] == [5]


def test_archive_search_prunes_months(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), "user", "Alpha"), (2, dt.datetime(2024, 1, 20), "user", "beta alpha")]
    df = spark.createDataFrame(rows, "msg_id int, ts timestamp_ntz, sender string, text string")
    readers.write_archive(log.fate(df, "2024-03-15"), str(tmp_path / "arch"))
    assert readers.search_archive(spark, str(tmp_path / "arch"), "ALPHA", "2024-01").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp_ntz, sender string, text string"
    rows = [(dt.datetime(2024, 1, 1, h), "user", t) for h, t in enumerate(["我放弃", "开心", "let me choose plan b", "ok"])]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.fan_out(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    want = ingest.decorate(df)
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/decisions")).count() == want.where("is_decision").count()
    assert sorted(r.mood for r in spark.read.parquet(str(tmp_path / "out/moods")).collect()) == sorted(r.mood for r in want.where("mood <> ''").collect())


def test_buffer_evicts_the_oldest(spark, tmp_path):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(8)] + [(2, 0, "x")], ingest.BUFFER)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.evicting_buffer(stream).writeStream.format("memory").queryName("evicted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("evicted").collect()) == [0, 1, 2]


def test_streams_keep_index_phantoms_and_replica(spark, tmp_path):
    from palimpsest.operators.index import Index
    from palimpsest.streaming import ingest

    schema = "msg_id long, ts timestamp, text string"
    source, at = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    rows = [[(k + 10 * b, at + dt.timedelta(hours=k + 10 * b), f"word{k % 3} both") for k in range(10)] for b in range(3)]
    index = Index(spark, str(tmp_path / "index"))
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(schema).parquet(source)
        ingest.keep_index(stream(), index, str(tmp_path / "c1"), once=True).awaitTermination()
        ingest.keep_phantoms(stream(), str(tmp_path / "ph"), str(tmp_path / "c2"), once=True).awaitTermination()
        ingest.replica(stream(), str(tmp_path / "copy"), str(tmp_path / "c3"), once=True).awaitTermination()
    whole = Index(spark, str(tmp_path / "whole"))
    whole.update(spark.read.parquet(source))
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, whole.postings().collect()))
    got = {r.token: r for r in ingest.phantoms(spark, str(tmp_path / "ph")).collect()}
    assert got["both"].sightings == 30 and got["both"].snippet == "word0 both" and got["word0"].sightings == 12
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 30


def test_counted_trigger_cools_down(spark, tmp_path):
    from palimpsest.streaming import ingest

    schema, source, at = "key string, ts timestamp", str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    got = []
    for hours, n in ((0, 3), (1, 2), (2, 5), (40, 5)):  # counts 3, 5, 10, 15
        spark.createDataFrame([("a", at + dt.timedelta(hours=hours))] * n, schema).coalesce(1).write.mode("append").parquet(source)
        out = ingest.counted_trigger(spark.readStream.schema(schema).parquet(source), every=5)
        q = out.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(k, n) for k, n, _ in got] == [("a", 5), ("a", 15)]  # the one at 10 came within 24 hours


def test_stated_queries_in_blocks(spark):
    from palimpsest.operators.blocks import against

    rows, queries = spark.range(7).toDF("a"), spark.range(50).toDF("b")
    pairs = lambda most: sorted(map(tuple, against(rows, queries, most).collect()))
    assert pairs(10) == pairs(1000) == [(a, b) for a in range(7) for b in range(50)]
