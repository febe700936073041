import json

import pytest
from pyspark.sql import functions as F

from lexweave.config import Config
from lexweave.operators import memory as M
from lexweave.sources import files as S
from lexweave.streaming import flows


def test_uploads_are_strict_utf8(spark, tmp_path):
    (tmp_path / "甲.txt").write_bytes("第一条　甲".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "x.pdf").write_bytes(b"no")
    good, bad = S.read_uploads(spark, str(tmp_path))
    assert [(r.source.split("/")[-1], r.text) for r in good.collect()] == [("甲.txt", "第一条　甲")] or good.count() == 1
    assert bad.count() == 1


def test_histories_round_trip(spark, tmp_path):
    ms = [{"type": "human", "data": {"content": "q", "type": "human", "additional_kwargs": {}}}, {"type": "ai", "data": {"content": None, "type": "ai"}}]
    (tmp_path / "chat_0123456789ab").write_text(json.dumps(ms))
    (tmp_path / "chat_broken").write_text("{nope")
    (tmp_path / ".session_meta.json").write_text(json.dumps({"chat_0123456789ab": {"pinned": True}, "x": {}}))
    got = S.read_sessions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.session_id, r.pos, r.type, r.content) for r in got] == [("chat_0123456789ab", 0, "human", "q"), ("chat_0123456789ab", 1, "ai", None)]
    meta = S.read_session_meta(spark, str(tmp_path / ".session_meta.json"))
    assert {r.session_id: r.pinned for r in meta.collect()} == {"chat_0123456789ab": True, "x": False}
    m = S.read_sessions(spark, str(tmp_path)).withColumn("msg_id", F.col("pos"))
    back = json.loads(S.session_json(M.compress(m)).first().json)
    assert [x["data"]["content"] for x in back] == ["q", ""]
    S.clear_session(spark, str(tmp_path), "chat_0123456789ab")
    assert (tmp_path / "chat_0123456789ab").read_text() == "[]"
    with pytest.raises(ValueError):
        S.clear_session(spark, str(tmp_path), "../chat")


def test_stores(spark, tmp_path):
    d = spark.createDataFrame([("t", None, "h"), ("u", "c", "h")], "text string, chapter string, md5 string")
    S.append_chunks(d.drop("md5"), str(tmp_path / "c"))
    S.append_fingerprints(d, str(tmp_path / "f"))
    assert {r.chapter for r in S.all_documents(spark.read.parquet(str(tmp_path / "c"))).collect()} == {"", "c"}
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1


def test_stream_ingests_each_text_once(spark, tmp_path):
    rows = [(1, "a.txt", "x\n第一条　甲", 1), (2, "b.txt", "x\n第一条　甲", 1), (3, "c.txt", "无条", 1)]
    up = lambda rs: spark.createDataFrame([(i, s, t, n, None) for i, s, t, n in rs], flows.UPLOAD_SCHEMA)
    src, chunks, reg, cp = (str(tmp_path / n) for n in ("in", "chunks", "reg", "cp"))
    for part in (rows, [(4, "d.txt", "x\n第一条　甲", 1), (5, "e.txt", "x\n第二条　乙", 1)]):
        up(part).coalesce(1).write.mode("append").parquet(src)
        flows.ingest_stream(spark, src, chunks, reg, cp, create_time="t").awaitTermination()
    got = spark.read.parquet(chunks)
    assert sorted(r.text for r in got.collect()) == ["第一条　甲", "第二条　乙"]
    assert spark.read.parquet(reg).count() == 2


def test_memory_stream_keeps_recent_rounds(spark, tmp_path):
    cfg = Config(keep_rounds=1, trigger_rounds=2)
    rows = [("s", 2 * i + k, t, f"{t}{i}") for i in range(3) for k, t in enumerate(("human", "ai"))]
    schema = "session_id string, pos bigint, type string, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = flows.memory_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cfg)
    q = out.writeStream.outputMode("update").format("memory").queryName("mem").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("mem").collect()
    assert len(r) == 1 and r[0].rounds == 1 and r[0].summary == "[用户] human0\\n[助手] ai0\\n[用户] human1\\n[助手] ai1"


def test_one_session_is_read_alone(spark, tmp_path):
    for name, text in (("chat_0123456789ab", "甲"), ("chat_ba9876543210", "乙")):
        (tmp_path / name).write_text(json.dumps([{"type": "human", "data": {"content": text, "type": "human"}}]), encoding="utf-8")
    got = S.read_session(spark, str(tmp_path), "chat_0123456789ab")
    assert [(r.session_id, r.content) for r in got.collect()] == [("chat_0123456789ab", "甲")] and len(got.inputFiles()) == 1
    assert S.read_session(spark, str(tmp_path), "../chat_0123456789ab").count() == 0
    assert S.read_session(spark, str(tmp_path), "chat_000000000000").count() == 0


@pytest.mark.parametrize("name", [".session_meta.json", "meta.json"])
def test_metadata_is_saved_and_read_again(spark, tmp_path, name):
    path = str(tmp_path / name)
    pins = spark.createDataFrame([("b", True), ("a", None), (None, True)], "session_id string, pinned boolean")
    for _ in range(2):  # written over what is there
        S.save_session_meta(pins, path)
    assert json.loads((tmp_path / name).read_text(encoding="utf-8")) == {"a": {"pinned": False}, "b": {"pinned": True}}
    assert sorted(map(tuple, S.read_session_meta(spark, path).collect())) == [("a", False), ("b", True)]
    S.save_session_meta(pins.limit(0), path)
    assert S.read_session_meta(spark, path).count() == 0 and S.read_session_meta(spark, path + "x").count() == 0
    (tmp_path / f".{name}.crc").unlink(missing_ok=True)
    (tmp_path / name).write_text("no json")
    assert S.read_session_meta(spark, path).count() == 0


def test_written_tables_are_deleted(spark, tmp_path, monkeypatch):
    from lexweave import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: tmp_path.as_uri())
    one, two = (runtime.materialize(spark.range(3), n) for n in ("one", "two"))
    assert one.count() == two.count() == 3 and len(list((tmp_path / "lexweave").iterdir())) == 2
    runtime.release(one)
    assert two.count() == 3
    runtime.clear_written(spark)
    assert list((tmp_path / "lexweave").iterdir()) == []


def test_written_tables_go_with_the_application(spark, tmp_path, monkeypatch):
    from lexweave import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: tmp_path.as_uri())
    d = runtime.materialize(spark.range(3), "one")
    p = spark._jvm.org.apache.hadoop.fs.Path(d._lexweave_path)
    assert p.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(p)


def test_shuffle_files_go_with_the_write(spark, tmp_path, monkeypatch):
    """They don't wait for the driver to collect its garbage; the session's own setting stays as it was."""
    import time

    from lexweave import runtime

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in map(lambda i: files.apply(i).getName(), range(files.size())) if n.startswith("shuffle_")}

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: tmp_path.as_uri())
    before, own = shuffled(), spark.conf.get(runtime.CLEANUP, None)
    many = spark.range(20_000).repartition(7, "id")
    d = runtime.materialize(many.groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    for _ in range(20):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and d.count() == 1000 and spark.conf.get(runtime.CLEANUP, None) == own
    for value in ("true", "false"):
        spark.conf.set(runtime.CLEANUP, value)
        runtime.materialize(many, "again")
        assert spark.conf.get(runtime.CLEANUP) == value
    with pytest.raises(Exception):
        runtime.materialize(many.select(F.raise_error(F.lit("no"))), "broken")
    assert spark.conf.get(runtime.CLEANUP) == "false"
    spark.conf.unset(runtime.CLEANUP)
    runtime.clear_written(spark)
