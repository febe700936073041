from pyspark.sql import functions as F

from lexweave.config import Config
from lexweave.functions import text as X
from lexweave.operators import ingest as I

STATUTE = "\r\n".join(
    "某法 / 目　录 / 第一编　总则 / 第一章　任务 / 第二章　犯罪 / 第一编　总则 / 第一章　任务 / 第一条　甲甲甲。 / 补充一行。 / （一九九七年修订） / 第二条　依照第一条 的规定。 / 第二章　犯罪 / 第一节　故意 / 第三条　乙乙。 / 第二节　过失 / 第四条　丙。 / 第五条　丁丁。".split(" / ")
)


def docs(spark, *texts):
    rows = [(i, f"s{i}.txt", t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "upload_id bigint, source string, text string")
    return d.withColumn("cleaned", I.clean_text(F.col("text")))


def test_cleaning_matches_the_known_hash(spark):
    r = docs(spark, STATUTE).select(F.md5("cleaned")).first()[0]
    assert r == "6cf3b4e51ce5692d759af03416567386"


def test_units(spark):
    got = I.article_units(docs(spark, STATUTE), "upload_id", "cleaned").orderBy("unit_ord").collect()
    assert [(r.unit_ord, r.chapter, r.section, r.article_no, len(r.text)) for r in got] == [
        (1, "第一章　任务", "", "第一条", 14),
        (2, "第一章　任务", "", "第二条", 6),
        (3, "第一章　任务", "", "第一条", 8),
        (4, "第二章　犯罪", "第一节　故意", "第三条", 7),
        (5, "第二章　犯罪", "第二节　过失", "第四条", 6),
        (6, "第二章　犯罪", "第二节　过失", "第五条", 7),
    ]
    assert {r.part for r in got} == {"第一编　总则"}


def test_chunks_without_and_with_overlap(spark):
    d = docs(spark, STATUTE)
    units = I.article_units(d, "upload_id", "cleaned")
    plain = I.with_metadata(I.pack_chunks(units, "upload_id", 16), units, d, "upload_id", create_time="t").orderBy("scope_ord", "chunk_no").collect()
    assert [(r.article_no, r.chunk_article_end, r.article_end, r.n_units) for r in plain] == [("第一条", "第一条", "第一条", 1), ("第二条", "第一条", "第一条", 2), ("第三条", "第三条", "第五条", 1), ("第四条", "第五条", "第五条", 2)]
    assert {(r.source, r.operator, r.create_time) for r in plain} == {("s0.txt", "", "t")}
    over = I.pack_chunks_overlapping(units, "upload_id", 16, 1).orderBy("scope_ord", "chunk_no").collect()
    assert [r.n_units for r in over] == [1, 2, 1, 1, 2, 1]
    same = I.pack_chunks_overlapping(units, "upload_id", 16, 0).drop("x").orderBy("scope_ord", "chunk_no").collect()
    assert [(r.text, r.n_units) for r in same] == [(r.text, r.n_units) for r in plain]


def test_oversize_article_is_one_chunk(spark):
    d = docs(spark, "x\n第一条　" + "甲" * 50 + "\n第二条　乙")
    units = I.article_units(d, "upload_id", "cleaned")
    got = I.pack_chunks(units, "upload_id", 16).orderBy("chunk_no").collect()
    assert [len(r.text) for r in got] == [54, 5]


def test_null_empty_and_plain_texts(spark):
    d = docs(spark, None, "", "没有条文", "　\n ")
    assert [r.cleaned for r in d.orderBy("upload_id").collect()] == [None, "", "没有条文", ""]
    assert I.article_units(d, "upload_id", "cleaned").count() == 0


def test_no_chunk_crosses_a_scope_and_none_is_lost(spark, data):
    d = spark.read.parquet(f"{data}/uploads.parquet").withColumn("cleaned", I.clean_text(F.col("text")))
    units = I.article_units(d, "upload_id", "cleaned")
    chunks = I.pack_chunks(units, "upload_id")
    assert chunks.agg(F.sum("n_units")).first()[0] == units.count()
    assert chunks.where("n_units > 1 and length(text) > 600").count() == 0


def test_deduplication_by_registry_and_arrival(spark):
    d = spark.createDataFrame([(1, "a", "h1", 2), (2, "a", "h1", 1), (3, "b", "h2", 1), (4, "c", "h3", 1)], "upload_id int, source string, md5 string, at int")
    reg = spark.createDataFrame([("H2 ",), ("h2",), (None,)], "md5 string")
    assert {r.upload_id for r in I.new_documents(d, reg, "upload_id", ["at"]).collect()} == {2, 4}


def test_status(spark):
    d = spark.createDataFrame([(1, "x\n第一条　甲", 1), (2, "x\n第一条　甲", 2), (3, "无条", 1), (4, "x\n第二条　乙", 1)], "upload_id int, text string, received_at int")
    reg = d.where("upload_id = 4").select(F.md5(I.clean_text(F.col("text"))).alias("md5"))
    got = {r.upload_id: r.status for r in I.ingest_status(d, reg).collect()}
    assert got == {1: "success", 2: "repeat", 3: "warn", 4: "repeat"}


def test_batches_of_ten(spark):
    d = spark.range(23).select(F.lit(1).alias("k"), "id")
    got = I.insert_batches(d, "k", ["id"]).groupBy("batch").count().orderBy("batch").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 10), (1, 10), (2, 3)]


def test_embedding_hook(spark):
    d = spark.createDataFrame([(i, "t" * i) for i in range(1, 24)], "id int, text string").coalesce(1)
    got = I.embed_in_batches(d, lambda ts: [[len(t), len(ts)] for t in ts]).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == list(range(1, 24)) and [r.embedding[1] for r in got][-1] == 3


def test_carried_metadata(spark):
    rows = [(1, 1, "第一编　总则\n第一章　任务\n第一条　甲"), (1, 2, "接上文"), (1, 3, "第二章　犯罪\n第三条　乙 第四条"), (2, 1, None)]
    d = spark.createDataFrame(rows, "k int, o int, text string")
    ends = spark.createDataFrame([(1, "第一章　任务", "第二条")], "k int, chapter string, article_end string")
    got = {(r.k, r.o): r for r in I.carried_metadata(d, "k", "o", ends).collect()}
    assert (got[1, 2].part, got[1, 2].chapter, got[1, 2].article_no, got[1, 2].article_end) == ("第一编　总则", "第一章　任务", "第一条", "第二条")
    assert (got[1, 3].chapter, got[1, 3].article_no, got[1, 3].chunk_article_end, got[1, 3].article_end) == ("第二章　犯罪", "第三条", "第四条", "第四条")
    assert got[2, 1].article_no == ""


def test_configured_title_line(spark):
    d = spark.createDataFrame([("甲法\n乙",)], "text string")
    assert d.select(I.clean_text(F.col("text"), Config(title_lines=("甲法",)))).first()[0] == "乙"


def test_strip_knows_unicode_blanks(spark):
    d = spark.createDataFrame([("　\x1c a \n",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(X.strip(F.col("t"))).collect()] == ["a", "", None]
