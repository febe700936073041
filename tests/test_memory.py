from pyspark.sql import functions as F

from lexweave.config import Config
from lexweave.operators import memory as M
from lexweave.operators import sessions as S

CFG = Config(keep_rounds=4, trigger_rounds=6, max_tokens=1500, summary_chars=800)


def chat(spark, rounds, n, session="s"):
    rows = []
    for i in range(1, rounds + 1):
        rows += [(session, 2 * i - 2, "human", f"用户第{i}轮:" + "U" * n), (session, 2 * i - 1, "ai", f"助手第{i}轮:" + "A" * n)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "msg_id int, session_id string, pos bigint, type string, content string")


def result(spark, rounds, n, cfg=CFG, summary=None):
    m = chat(spark, rounds, n)
    out = M.compress(m, cfg, (lambda o, t: F.lit(summary)) if summary else None).withColumn("tokens", F.greatest(F.floor(F.length("content") / 2), F.lit(1)) + 6)
    return out.where("type = 'human'").count(), out.where("ord = -1").count(), out.agg(F.sum("tokens")).first()[0], out


def test_below_trigger(spark):
    assert result(spark, 3, 20)[:3] == (3, 0, 114)


def test_trigger(spark):
    assert result(spark, 8, 20, summary="这是摘要")[:3] == (4, 1, 169)


def test_budget_is_clamped_and_the_newest_round_stays(spark):
    cfg = Config(keep_rounds=4, trigger_rounds=6, max_tokens=180, summary_chars=800)
    assert result(spark, 10, 120, cfg, "短摘要")[:3] == (1, 1, 155)


def test_fallback_summary_is_bounded(spark):
    kept, summaries, _, out = result(spark, 8, 300)
    text = out.where("ord = -1").first().content
    assert kept == 3 and summaries == 1 and len(text) == 800 + len("[SESSION_SUMMARY]\\n") and text.startswith("[SESSION_SUMMARY]\\n[用户] 用户第1轮:U")


def test_recompression_is_stable(spark):
    _, _, tokens, out = result(spark, 9, 25, summary="稳定摘要")
    again = out.withColumn("msg_id", F.monotonically_increasing_id()).withColumn("pos", F.col("ord") + 1)
    two = M.compress(again, CFG).withColumn("tokens", F.greatest(F.floor(F.length("content") / 2), F.lit(1)) + 6)
    assert (tokens, two.agg(F.sum("tokens")).first()[0], two.where("type = 'human'").count(), two.where("ord = -1").count()) == (185, 186, 4, 1)


def test_lossless_keeps_what_no_summary_covers(spark):
    m = chat(spark, 5, 5)
    assert M.compress(m, CFG).where("type = 'human'").count() == 4
    assert M.compress(m, Config(keep_rounds=4, trigger_rounds=6, lossless=True)).where("type = 'human'").count() == 5


def test_rounds_against_a_loop_in_blocks(spark):
    import random

    random.seed(3)
    rows, want = [], {}
    for s in ("a", "b", "c"):
        r, cur = -1, 0
        for pos in range(60):
            t = random.choice(["human", "ai", "assistant", "user", "system"])
            rows.append((len(rows), s, pos, t, None if pos % 7 == 0 else "x"))
            if r < 0 or t in ("human", "user"):
                r += 1
            want[s, pos] = r
    d = spark.createDataFrame(rows, "msg_id int, session_id string, pos bigint, type string, content string")
    old, M.BLOCK = M.BLOCK, 7
    try:
        got = {(r.session_id, r.pos): r.round_id for r in M.rounds(d).collect()}
    finally:
        M.BLOCK = old
    assert got == want
    assert {r.session_id: r.rounds for r in M.session_rounds(d).collect()} == {s: max(v for (x, _), v in want.items() if x == s) + 1 for s in "abc"}


def test_tag_needs_system_type_and_repeats_count_once(spark):
    rows = [(1, "s", 0, "system", "[SESSION_SUMMARY]\nabc "), (2, "s", 1, "human", "[SESSION_SUMMARY] q"), (3, "s", 1, "human", "[SESSION_SUMMARY] q"), (4, "s", 2, "system", "other"), (5, None, 0, "ai", "x")]
    d = spark.createDataFrame(rows, "msg_id int, session_id string, pos bigint, type string, content string")
    assert M.old_summary(d).first().old_summary == "abc"
    assert M.rounds(d).count() == 2
    assert M.compress(d.limit(0)).count() == 0


def test_sessions(spark):
    rows = [(1, "chat_0123456789ab", 0, "human", "　 请问借款怎么办，很长很长很长很长的问题", 10), (2, "chat_b", 0, "ai", None, 30), (3, "other", 0, "human", "x", 5), (4, "chat_c", 1, "user", "   ", 30)]
    m = spark.createDataFrame(rows, "msg_id int, session_id string, pos bigint, type string, content string, stored_at int")
    meta = spark.createDataFrame([("chat_0123456789ab", False, 1), ("chat_0123456789ab", True, 2), ("chat_b", None, 1), ("gone", True, 1)], "session_id string, pinned boolean, updated_at int")
    assert {r.session_id: r.label for r in S.session_labels(m).collect()} == {"chat_0123456789ab": "请问借款怎么办，很长很长很长很长的问题"[:15], "chat_b": "新会话", "other": "x", "chat_c": "新会话"}
    assert [(r.session_id, r.pinned) for r in S.list_sessions(m, meta).collect()] == [("chat_0123456789ab", True), ("chat_b", False), ("chat_c", False)]
    assert {r.session_id for r in S.delete_sessions(m, meta).collect()} == {"chat_b", "other", "chat_c"}
    assert {r.session_id: r.pinned for r in S.toggle(meta, m.select("session_id")).collect()} == {"chat_0123456789ab": False, "chat_b": True, "chat_c": True, "other": True, "gone": True}
    log = spark.createDataFrame([("a", "pin", 1), ("a", "unpin", 2), ("b", "pin", 1), ("b", "open", 5), ("c", "pin", 1), ("c", "delete", 2)], "session_id string, action string, at int")
    pins, gone = S.apply_actions(meta, log)
    assert {r.session_id: r.pinned for r in pins.collect()} == {"chat_0123456789ab": True, "chat_b": False, "gone": True, "a": False, "b": True}
    assert [r.session_id for r in gone.collect()] == ["c"]
    assert {r.session_id: r.active for r in S.sidebar(m, meta, "chat_b").collect()}["chat_b"] is True


def test_display(spark):
    rows = [(1, "a", 0, "system", "[SESSION_SUMMARY]x"), (2, "b", 0, "human", "q"), (3, "b", 1, "system", "note")]
    m = spark.createDataFrame(rows, "msg_id int, session_id string, pos bigint, type string, content string")
    got = {(r.session_id, r.pos): (r.role, r.content) for r in S.display_history(m).collect()}
    assert got[("b", 0)] == ("user", "q") and got[("b", 1)] == ("assistant", "note") and got[("a", 0)][0] == "assistant" and len(got) == 3


def test_small_session_functions(spark):
    from lexweave.functions import text as X

    lst = spark.createDataFrame([("chat_a",)], "session_id string").selectExpr("session_id", "true as pinned", "cast(null as timestamp_ntz) as last_stored")
    assert sorted((r.place, r.session_id) for r in S.with_active(lst, "chat_new").collect()) == [(0, "chat_new"), (1, "chat_a")]
    assert S.with_active(lst, "chat_a").count() == 1
    meta = spark.createDataFrame([("a", True, 1)], "session_id string, pinned boolean, updated_at int")
    assert {r.session_id: r.pinned for r in S.set_pins(meta, spark.createDataFrame([("a", False, 2), ("b", True, 1)], meta.schema)).collect()} == {"a": False, "b": True}
    assert S.is_pinned(meta, "a").first().pinned and S.is_pinned(meta, "z").count() == 0
    assert spark.range(3).select(X.new_session_id().alias("s")).where(F.col("s").rlike(X.VALID_SESSION_ID)).count() == 3
    text = spark.createDataFrame([("第一编　总则\n第一章\n第二条　见第九条",)], "t string")
    r = text.select(X.last_match(F.col("t"), X.ARTICLE).alias("a"), X.last_match(F.col("t"), X.heading_lines("章")).alias("c"), X.last_match(F.col("t"), X.heading_lines("节")).alias("s"), X.all_matches(F.col("t"), X.ARTICLE).alias("l")).first()
    assert (r.a, r.c, r.s, r.l) == ("第九条", "第一章\n第二条　见第九条", None, ["第二条", "第九条"])
    assert M.summary_prompt is not None and spark.range(1).select(M.summary_prompt(F.lit(""), F.lit("x")).alias("p")).first().p.count("（无）") == 1


def test_a_turn_reads_asks_appends_and_compresses(spark):
    from lexweave.operators import prompt as P
    from lexweave.operators import memory as M

    stored = spark.createDataFrame([(1, "s", 0, "human", "问一"), (2, "s", 1, "ai", "答一"), (3, "s", 1, "ai", "答一")], "msg_id bigint, session_id string, pos bigint, type string, content string")
    asked = spark.createDataFrame([("s", "问二"), ("new", "头一问")], "session_id string, question string")
    context = spark.createDataFrame([("资料",)], "context string")
    answered, history = P.chat_turn(stored, asked, context, model=lambda prompts: [f"答{len(p)}" for p in prompts])
    got = {r.session_id: r for r in answered.collect()}
    assert "[用户] 问一\n[助手] 答一\n问题：问二" in got["s"].prompt and got["s"].answer == f"答{len(got['s'].prompt)}"
    assert "[用户]" not in got["new"].prompt
    rows = {}
    for r in history.orderBy("session_id", "ord").collect():
        rows.setdefault(r.session_id, []).append((r.ord, r.type, r.content))
    assert rows["s"] == [(0, "human", "问一"), (1, "ai", "答一"), (2, "human", "问二"), (3, "ai", got["s"].answer)]
    assert rows["new"] == [(0, "human", "头一问"), (1, "ai", got["new"].answer)]
    assert M.add_messages(stored.limit(0), stored.limit(0).drop("msg_id")).count() == 0


def test_places_of_rows_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from lexweave.operators.sessions import numbered

    d = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r.place == r.v + 1 for r in numbered(d, "v").collect())
    assert numbered(d.limit(0), "v").count() == 0
