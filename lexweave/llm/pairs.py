"""Broken prompt and response pairs: empty, copied, refused, wrong-language and truncated answers.

Method: for every kind of defect a few noisy labelling functions vote on each answer (SQL expressions, JVM-side). An
expectation-maximisation label model turns the counts of vote patterns into posteriors; an answer has every defect
whose posterior exceeds its cutoff. Cutoffs are validated: each defect is planted into every answer long enough to hold it, and
the cutoff with the best F1 on these known cases is taken. found_defects() keeps one defect per answer, in the
order of PRECEDENCE (a copy in the wrong language is a copy).

One labelling function needs the corpus: whether the unfinished end of an answer is elsewhere a finished sentence.
Sentence shapes (numbers folded) are counted over all answers first, so what is joined is one row per shape.

Scale: questions meet answers on (session_id, pos), so one huge session spreads over all tasks; messages stored twice
are merged on the question side. Planted answers are counted by votes where they are made and meet the shapes as
counts; what the votes need of a fixed text is made once. Vote patterns, at most 3 ** 4 per defect, are all that reaches the driver.

An answer without content is empty. An answer without question cannot be a copy nor in the wrong language. Rows whose
type is null are ignored; a null session or position has no question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.labelmodel import best_cutoff, posteriors
from lexweave.runtime import materialize, release

PRECEDENCE = ("empty", "copy", "refusal", "language", "truncated")
PRIOR = {"empty": 0.02, "copy": 0.02, "refusal": 0.02, "language": 0.02, "truncated": 0.02}

# Wording of refusals, of polite phrases around them and of answers that do help.
REFUSES = (
    "(?=[无不没恕拒帮爱请问超我a-zA-Z])(?:(无法|不能|不便|不会|没法|恕不|不予|拒绝)(直接|继续|对此|就此|就这件事|为您|给您|给你|向您)*(回答|协助|作答|处理|提供|给出|发表|作出|评论|解答|讨论|提出|透露)"
    "|恕(我)?(不能|无法|难)|帮不上忙|爱莫能助|无可奉告|(请求|问题)已被拒绝|超出了?(我|本系统|助手)|不支持(解答|回答|处理)|没有权限|我?没有办法(帮|回答)"
    "|(?i)(can(no|'|’)?t|cannot|unable to|not able to|won['’]t|will not|decline to|must decline|not allowed to|not permitted to) ?(to )?(help|assist|answer|provide|give|comment|discuss|respond|offer|advise|do that|say)"
    "|(?i)no comment|(?i)against (my|our|the) polic|(?i)policy prevents|(?i)(outside|beyond) (my|the) scope)"
)
POLITE = (
    "抱歉|对不起|不好意思|遗憾|请谅解|请您?理解|感谢|谢谢|您好|作为.{0,6}(助手|模型)|换一个话题|聊点别的|另寻渠道|联系线下|欢迎再来|出于.{0,8}考虑|自己决定"
    "|(?i)sorry|(?i)apolog|(?i)unfortunately|(?i)understand|(?i)instead|(?i)does not cover|(?i)as an? (ai|assistant|language)|(?i)thank you"
)
HELPS = "建议您?先|可以申请|可以先|如下|理由|逐条|梳理|结论|需要注意|按照|根据|举证|程序|(?i)first |(?i)collect|(?i)you (can|may)|(?i)it depends|(?i)start with|(?i)keep the"
# How a question names the language of the answer.
ASKED = {
    "en": "英文|英语|(?i)\\bin english\\b",
    "zh": "(用|写成|译成|翻译成)(中文|汉语|普通话)|(?i)\\bin chinese\\b",
    "ja": "日语|日文|(?i)\\bin japanese\\b",
    "ko": "韩语|韩文|(?i)\\bin korean\\b",
    "ru": "俄语|俄文|(?i)\\bin russian\\b",
    "fr": "法语|法文|(?i)\\bin french\\b",
    "de": "德语|德文|(?i)\\bin german\\b",
    "es": "西班牙语|(?i)\\bin spanish\\b",
}
# Small words that tell Latin-script languages apart.
SMALL = {
    "en": "the|of|to|and|you|is|are|can|for|with|this|that|not|your|will|do|it",
    "de": "der|die|das|und|ist|sie|nicht|vom|eine|ein|den|zu|mit|auf|sich|ihre",
    "fr": "le|la|les|des|de|du|vous|est|une|et|pour|votre|selon|dans|ne|pas",
    "es": "el|los|las|del|que|una|por|para|puede|todos|su|se|en|no|sus|con",
}
EMPTY_WORDS = "无|空|（空）|\\(空\\)|(?i)null|(?i)none|(?i)nil|(?i)n/?a|(?i)nan|(?i)undefined|(?i)todo|(?i)tbd|暂无|待补充|没有内容|占位"
#: A closing phrase ends at least one answer in so many.
CLOSING_SHARE = 2000
_MARKUP = "<[^<>]{0,40}>|&nbsp;|[`*#>_~|\\-=.…。·]"
_INVISIBLE = "[\\s\\p{Cf}\\x{3164}\\x{115f}]"
_NUMBER = "[0-9０-９一二三四五六七八九十百千万亿零〇两.%]+"
_LAST = "(?:^|[。！？!?\\n]|\\.\\s)\\s*(?:[-*•]\\s+|\\d+[.、)]\\s*|#{1,6}\\s+)?([^。！？!?\\n]*)$"


def _has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(f"(?U){pattern}" if "\\s" in pattern else pattern))


def _strip(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?U){pattern}", "")


def _vote(*cases: tuple[Column, int]) -> Column:
    """The first true condition votes; none abstains."""
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), F.lit("+" if cases[0][1] > 0 else "-"))
    for c, v in cases[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), F.lit("+" if v > 0 else "-"))
    return out.otherwise(F.lit("0"))


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(msg_id, answer, question): every ai message with the human message before it, if there is one."""
    m = messages.select("msg_id", "session_id", F.col("pos").cast("bigint").alias("pos"), F.col("type").alias("kind"), F.col("content").cast("string").alias("content"))
    asked = m.where("kind in ('human', 'user')").groupBy("session_id", (F.col("pos") + 1).alias("pos")).agg(F.min("content").alias("question"))
    return m.where("kind in ('ai', 'assistant')").select("msg_id", "session_id", "pos", F.col("content").alias("answer")).join(asked, ["session_id", "pos"], "left").select("msg_id", "answer", "question")


def sentence_shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[\\s\\x{3000}*_`#。！？!?]+", ""), _NUMBER, "#")


def finished_shapes(answers: DataFrame) -> DataFrame:
    """(shape_hash): sentences that end with a full stop at least twice in all answers, and usual closing lines."""
    ends = F.filter(F.split("answer", "\\n|(?<=[。！？!?])"), lambda s: F.regexp_like(s, F.lit("..[。！？!?]$")))
    head = "^\\s*(?:[-*•]\\s+|\\d+[.、)]\\s*|#{1,6}\\s+)?"
    # A plain explode() would filter for empty arrays first, and so make every array twice.
    one = answers.select(F.explode_outer(ends).alias("s")).where("s is not null").select(F.xxhash64(sentence_shape(F.regexp_replace("s", head, ""))).alias("shape_hash"))
    ended = one.groupBy("shape_hash").count().where("count > 1").select("shape_hash")
    # A last line without full stop that ends many answers is a closing phrase. How many depends on their number.
    line = F.regexp_extract(F.regexp_replace("answer", "(?U)\\s+$", ""), "\\n([^\\n]*[^\\n，、：；,:;。！？!?.…])$", 1)
    close = answers.select(line.alias("s")).where(F.length("s") > 3).select(F.xxhash64(sentence_shape(F.regexp_replace("s", head, ""))).alias("shape_hash"))
    often = answers.agg(F.greatest(F.lit(5), F.count("*") / CLOSING_SHARE).alias("often"))
    close = close.groupBy("shape_hash").count().crossJoin(F.broadcast(often)).where("count >= often").select("shape_hash")
    return ended.unionByName(close).distinct()


_RARE = "[\\x{c0}-\\x{24f}\\x{370}-\\x{e7f}\\x{1100}-\\x{11ff}\\x{3041}-\\x{30fe}\\x{ac00}-\\x{d7a3}]"


def _scripts(c: Column, rare: Column) -> dict[str, Column]:
    """Weight of each script in a text; rare says whether it has letters besides ideographs and ASCII."""

    def n(cls: str) -> Column:  # whole runs are taken out: few steps for the script a text is written in
        return (F.length(c) - F.length(F.regexp_replace(c, f"[{cls}]+", ""))).cast("double")

    def seldom(cls: str) -> Column:
        return F.when(rare, n(cls)).otherwise(F.when(c.isNotNull(), 0.0))

    return {
        "zh": n("\\x{3400}-\\x{9fff}\\x{20000}-\\x{32000}"),
        "latin": F.when(rare, n("A-Za-z\\x{c0}-\\x{24f}")).otherwise(n("A-Za-z")) / 4.0,
        "ru": seldom("\\x{400}-\\x{52f}") / 4.0,
        "ko": seldom("\\x{ac00}-\\x{d7a3}\\x{1100}-\\x{11ff}"),
        "ja": seldom("\\x{3041}-\\x{30fe}") * 1.5,
        "other": seldom("\\x{370}-\\x{3ff}\\x{590}-\\x{6ff}\\x{900}-\\x{e7f}") / 3.0,
    }


def _main_script(s: dict[str, Column]) -> Column:
    most = F.greatest(*s.values())
    out = F.when(most.isNull() | (most <= 0), F.lit(None).cast("string")).when(s["ja"] * 4 >= most, "ja")
    for k in ("zh", "latin", "ru", "ko"):
        out = out.when(s[k] == most, k)
    return out.otherwise("other")


def _small_words(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    return {k: F.regexp_count(low, F.lit(f"\\b({w})\\b")) for k, w in SMALL.items()}


def _latin_language(n: dict[str, Column]) -> Column:
    most = F.greatest(*n.values())
    out = F.when(most == 0, F.lit(None).cast("string"))
    for k in n:
        out = out.when(n[k] == most, k)
    return out


# Answers planted as defects.
_PLANTED = {
    "empty": ("", " \n", "……", "<br>", "无", "null"),
    "refusal": ("抱歉，我无法回答这个问题。", "很遗憾，这个请求我不能协助，请谅解。", "I'm sorry, but I can't help with that request.", "这个问题超出了我能处理的范围，无法提供意见。"),
    "language": ("Please collect the papers first and then file the short form with the board; it depends on the contract.", "Die Kosten hängen vom Vertrag ab, und Sie sollten die Unterlagen nicht aus der Hand geben."),
}
_FOREIGN = "建议您先整理合同和付款记录，再向主管部门提出书面申请，必要时可以申请调解。"


#: Answers into which defects are planted.
_PLANTABLE = "question is not null and length(answer) > 60 and length(question) > 8"


def planted_defects(pairs: DataFrame, only: tuple[str, ...] = ("", *PRECEDENCE)) -> DataFrame:
    """(msg_id, planted, answer, question): every plantable answer with each defect in turn, and as it is (planted '').

    Columns about the question alone go along.
    """
    one = lambda k: F.element_at(F.array(*map(F.lit, _PLANTED[k])), (F.pmod(F.xxhash64("msg_id", F.lit(k)), F.lit(len(_PLANTED[k]))) + 1).cast("int"))
    kinds = {
        "": F.col("answer"),
        "empty": one("empty"),
        "refusal": one("refusal"),
        "language": F.when(F.regexp_like("question", F.lit("[一-龥]{3}")), one("language")).otherwise(F.lit(_FOREIGN)),
        "copy": F.when(F.pmod(F.xxhash64("msg_id"), F.lit(2)) == 0, F.col("question")).otherwise(F.concat(F.lit("问："), F.col("question"))),
        "truncated": F.substring("answer", F.lit(1), (F.length("answer") * 0.6).cast("int")),
    }
    many = F.explode(F.array(*[F.struct(F.lit(k).alias("planted"), c.alias("answer")) for k, c in kinds.items() if k in only]))
    others = [c for c in pairs.columns if c not in ("msg_id", "answer", "question")]
    return pairs.where(_PLANTABLE).select("msg_id", "question", *others, many.alias("x")).select("msg_id", "x.planted", "x.answer", "question", *others)


def _folded(c: Column) -> Column:
    """Letters and digits of a text, without the words that announce a question; you and I are the same."""
    head = "^(问|您问|你问|我问|您的问题|你的问题|我的问题|问题|原问题|yourquestion|youasked|question|q)(是|的是)?"
    return F.regexp_replace(F.regexp_replace(F.lower(_strip(c, "[^\\p{L}\\p{N}]")), "[你您]", "我"), head, "")


def question_columns(pairs: DataFrame) -> DataFrame:
    """The pairs with what the votes need of the question: folded, and the language and script its answer should have."""
    if "_fq" in pairs.columns:
        return pairs
    q = F.col("question")
    base = pairs.withColumns({"_fq": _folded(q), "_rq": F.regexp_like(q, F.lit(_RARE))})
    sq = _scripts(q, F.col("_rq"))
    asked = F.coalesce(*[F.when(F.regexp_like(q, F.lit(p)), k) for k, p in ASKED.items()])
    asked = F.when(F.regexp_like(q, F.lit("[文语话]|(?i)\\bin ")), asked)
    base = base.withColumns({f"_t_{k}": v for k, v in sq.items()} | {"_asked": asked})
    base = base.withColumn("_qs", _main_script({k: F.col(f"_t_{k}") for k in sq}))
    base = base.withColumns({f"_m_{k}": F.when(F.col("_qs") == "latin", v) for k, v in _small_words(q).items()})
    theirs = _latin_language({k: F.col(f"_m_{k}") for k in SMALL})
    base = base.withColumn("_want", F.coalesce("_asked", F.when(F.col("_qs") == "latin", theirs).otherwise(F.col("_qs"))))
    base = base.withColumn("_ws", F.when(F.col("_want").isin("en", "fr", "de", "es", "latin"), "latin").otherwise(F.col("_want")))
    return base.select(*pairs.columns, "_fq", "_want", "_ws")


def answer_columns(pairs: DataFrame) -> DataFrame:
    """The pairs with what the votes need of the answer alone."""
    if "_fa" in pairs.columns:
        return pairs
    a = F.coalesce("answer", F.lit(""))
    bare = _strip(a, _INVISIBLE)
    core = _strip(_strip(bare, _MARKUP), "[^\\p{L}\\p{N}]")
    base = pairs.withColumns({"_bare": bare, "_core": core, "_fa": _folded(a)})
    quoted = "“[^”]*”|\"[^\"]*\"|「[^」]*」|《[^》]*》|（[^）]*）|\\([^)]*\\)|```.*?```"
    own = F.when(F.regexp_like(a, F.lit("[“\"「《（(`]")), F.regexp_replace(a, f"(?s){quoted}", "")).otherwise(a)
    own = F.when(F.length(own) * 4 < F.length(a), a).otherwise(own)
    base = base.withColumn("_own", own)
    base = base.withColumn("_ra", F.regexp_like("_own", F.lit(_RARE)))
    sa = _scripts(F.col("_own"), F.col("_ra"))
    # What several conditions use is a column of its own before they are written, else each would make it again.
    base = base.withColumns({f"_s_{k}": v for k, v in sa.items()})
    sa = {k: F.col(f"_s_{k}") for k in sa}
    base = base.withColumn("_as", _main_script(sa))
    base = base.withColumns({f"_n_{k}": F.when(F.col("_as") == "latin", v) for k, v in _small_words(F.col("_own")).items()})
    mine = _latin_language({k: F.col(f"_n_{k}") for k in SMALL})
    base = base.withColumn("_got", F.when(F.col("_as") == "latin", F.coalesce(mine, F.lit("latin"))).otherwise(F.col("_as")))
    trimmed = F.rtrim(a, F.lit(" \t\n\x0b\f\r\u3000"))
    end = F.right(F.rtrim(a, F.lit(" \t\n\x0b\f\r\u3000*_`\ufeff\u200b")), F.lit(1))
    opened = lambda o, c: F.length(F.regexp_replace(a, f"[{c}]+", "")) > F.length(F.regexp_replace(a, f"[{o}]+", ""))
    base = base.withColumns(
        {
            "_refusal": F.regexp_like(a, F.lit(REFUSES)),
            "_trimmed": trimmed,
            "_no_end": ~end.isin(*"。！？!?.～~)）】》」”\"|>") & ~F.regexp_like(end, F.lit("\\p{So}")),
        }
    )
    last = F.right("_trimmed", F.lit(40))  # what ends a text is looked for at its end only
    base = base.withColumn("_dots", F.regexp_like(last, F.lit("(?:\\.{3}|…|[，、：；,:;（(《“‘—\\-])$")))
    base = base.withColumns({"_unfinished": F.col("_no_end") | F.col("_dots"), "_tail": F.when(F.col("_no_end"), F.regexp_extract("_trimmed", _LAST, 1)).otherwise(F.lit(""))})
    pieces = F.split(a, "[。！？!?\\n.]+")
    rest = F.length(F.regexp_replace(F.array_join(F.filter(pieces, lambda s: ~(F.regexp_like(s, F.lit(REFUSES)) | F.regexp_like(s, F.lit(POLITE)))), ""), "[^\\p{L}\\p{N}]+", ""))
    base = base.withColumns(
        {
            "_rest": F.when(F.col("_refusal"), rest).otherwise(F.lit(1000)),
            "_hangs": F.regexp_like(last, F.lit("(?:但是|而且|以及|因为|如果|其次|另外|并且|或者|例如|比如|包括|，如|\\b(?i:and|but|or|the|of|to|is|with|for|a|at))$")),
            "_marker": F.regexp_like(last, F.lit("(?:^|\\n)[ \\t]*(?:\\d+[.、)]|[-*•|]|\\*{2,3}|#{1,6}(?:[ \\t]*\\d+[.、)]?)?)$")),
            "_open": F.col("_unfinished") & (opened("（(", "）)") | opened("《", "》") | opened("“", "”") | (F.regexp_count(a, F.lit("\\*\\*")) % 2 == 1) | (F.regexp_count(a, F.lit("```")) % 2 == 1)),
            "_shape": F.when(F.col("_no_end") & (F.col("_tail") != ""), F.xxhash64(sentence_shape(F.col("_tail")))),
            "_helps": F.regexp_like(a, F.lit(HELPS)),
            "_polite": F.when(F.col("_refusal"), F.regexp_like(a, F.lit(POLITE))),
            "_word": F.regexp_like(F.trim(F.regexp_replace(F.col("_bare"), "[\\[\\]{}<>]", "")), F.lit(f"^(?:{EMPTY_WORDS})$")),
        }
    )
    return base.select(*pairs.columns, "_bare", "_core", "_fa", *[f"_s_{k}" for k in sa], "_as", "_got", "_refusal", "_no_end", "_dots", "_rest", "_hangs", "_marker", "_open", "_shape", "_helps", "_polite", "_word")


def _cast(pairs: DataFrame, keep: tuple[str, ...], spread: Column) -> DataFrame:
    """(the columns to keep, votes of the defects that need no sentence shapes, the shape an answer ends in, what else says truncated).

    An answer that ends well needs no shape and gets spread instead.
    """
    q = F.col("question")
    base = answer_columns(question_columns(pairs))
    sa = {k: F.col(k) for k in base.columns if k.startswith("_s_")}
    total = sum(sa.values(), F.lit(0.0))
    of_want = F.lit(0.0)
    for k in sa:
        of_want = F.when(F.col("_ws") == k.removeprefix("_s_"), sa[k]).otherwise(of_want)
    base = base.withColumn("_share", F.when(total > 0, of_want / total))
    la, lq = F.length("_fa"), F.length("_fq")
    limit = F.greatest(F.lit(40), (lq * 0.2).cast("int"))  # further apart than this is no copy, whatever the length

    def apart(two: Column) -> Column:
        short = F.levenshtein(F.col("_fa"), two, 40)  # ends early, with -1
        found = F.when(lq <= 200, F.nullif(short, F.lit(-1))).otherwise(F.levenshtein(F.col("_fa"), two))
        return F.when(F.abs(la - F.length(two)) <= limit, found)  # texts of other lengths are further apart anyway

    base = base.withColumns(
        {
            "_lev": F.least(apart(F.col("_fq")), apart(F.concat("_fq", "_fq"))),
            "_same_start": F.contains("_fa", F.substring("_fq", 1, 4)),
            "_holds": F.contains("_fa", "_fq"),
            "_left": F.length(F.replace("_fa", "_fq", F.lit(""))),
            "shape_hash": F.coalesce("_shape", spread),
        }
    )
    core_c = F.col("_core")
    refusal, rest, left, holds = F.col("_refusal"), F.col("_rest"), F.col("_left"), F.col("_holds")
    no_end, hangs, marker, dots = F.col("_no_end"), F.col("_hangs"), F.col("_marker"), F.col("_dots")
    real = F.length(core_c) > 6
    near = F.col("_lev") <= limit
    alone = q.isNull() | (lq < 4)  # nothing that could be copied
    far = F.col("_lev") <= F.greatest(F.lit(2), (lq * 0.2).cast("int"))
    close = F.col("_lev") <= F.greatest(F.lit(1), (lq * 0.1).cast("int"))
    # Both in Latin letters, but the small words of the answer are those of another language.
    foreign = (F.col("_as") == "latin") & (F.col("_ws") == "latin") & (F.col("_got") != "latin") & (F.col("_got") != F.col("_want"))

    votes = {
        "empty": [
            _vote((F.length(F.col("_bare")) == 0, 1), (real, -1)),
            _vote((F.length(core_c) == 0, 1), (real, -1)),
            _vote((F.col("_word") | (F.length(core_c) == 0), 1), (F.length(core_c) > 3, -1)),
        ],
        "copy": [
            _vote((alone, -1), (real & holds & (left == 0), 1), (la > lq * 2 + 20, -1)),
            _vote((alone, -1), (real & holds & (left <= 12), 1), (real & near & close, 1), (real & holds & (left > 20), -1), (~F.col("_same_start"), -1)),
            _vote((alone, -1), (real & near & far, 1), (la > lq * 2.6 + 12, -1), (real & ~F.coalesce(near, F.lit(False)) & (left > 12), -1)),
        ],
        "refusal": [
            _vote((refusal, 1), (F.length(core_c) > 0, -1)),
            _vote((refusal & (rest <= 4), 1), (rest > 20, -1)),
            _vote((F.col("_helps") & ~(refusal & (rest <= 12)), -1), (refusal & (F.length(core_c) < 160), 1)),
            _vote((refusal & F.col("_polite"), 1), (F.length(core_c) > 150, -1)),
        ],
        "language": [
            _vote((F.col("_as").isNull() | F.col("_ws").isNull() | (F.length(core_c) <= 6), -1), (F.col("_as") != F.col("_ws"), 1), (foreign, 1), (F.col("_as") == F.col("_ws"), -1)),
            _vote((F.col("_ws").isNull() | (F.length(core_c) <= 6), -1), (F.col("_share") < 0.35, 1), (foreign, 1), (F.col("_share") > 0.5, -1)),
            _vote((F.col("_ws").isNull() | (F.length(core_c) <= 6), -1), (F.col("_want").isNotNull() & (F.col("_got") != F.col("_want")) & ~((F.col("_got") == "latin") & (F.col("_ws") == "latin")), 1), (F.col("_got") == F.col("_want"), -1)),
        ],
    }
    cut = {"_real": real, "_dots": dots, "_no_end": no_end, "_marker": marker, "_hang": hangs | marker | dots, "_open": F.col("_open")}
    return base.select(*keep, *[F.concat(*v).alias(k) for k, v in votes.items()], "shape_hash", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in cut.items()])


def _settled(rows: DataFrame, shapes: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(the columns to keep, one string of votes per defect). Only votes and a hash go through the join, no text."""
    rows = rows.join(shapes.select("shape_hash", F.lit(True).alias("_known")), "shape_hash", "left")
    real, dots, no_end, marker, hang, open_ = (F.col(k) for k in ("_real", "_dots", "_no_end", "_marker", "_hang", "_open"))
    known = F.col("_known").isNotNull()
    truncated = [
        _vote((~real, -1), (dots | (no_end & ~known), 1), (~no_end & ~marker, -1)),
        _vote((~real, -1), (hang, 1), (~no_end, -1)),
        _vote((~real, -1), (open_, 1)),
        _vote((~real, -1), (hang, 1), (known & no_end, -1), (no_end, 1), (F.lit(True), -1)),
    ]
    return rows.select(*keep, *PRECEDENCE[:-1], F.concat(*truncated).alias("truncated"))


def voted(pairs: DataFrame, shapes: DataFrame, keep: tuple[str, ...] = ("msg_id",)) -> DataFrame:
    """(the columns to keep, one string of votes per defect); the keys of finished answers spread over all tasks and meet no shape."""
    return _settled(_cast(pairs, keep, F.xxhash64("msg_id", F.lit(7))), shapes, keep)


def planted_votes(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(planted, one string of votes per defect, cases): the votes on all planted defects, counted before they meet the shapes."""
    asked = question_columns(pairs)
    texts = [(t,) for t in (*[t for ts in _PLANTED.values() for t in ts], _FOREIGN)]
    fixed = answer_columns(pairs.sparkSession.createDataFrame(texts, "answer string"))  # once for each text
    rows = None
    for some in (planted_defects(asked, tuple(_PLANTED)).join(F.broadcast(fixed), "answer"), planted_defects(asked, ("copy", "truncated"))):
        votes = _cast(some, ("planted",), F.lit(None).cast("bigint"))
        rows = votes if rows is None else rows.unionByName(votes)
    return _settled(rows.groupBy(*rows.columns).agg(F.count("*").alias("cases")), shapes, ("planted", "cases"))


def _counted(votes: DataFrame, *by: str) -> list:
    n = F.col("cases") if "cases" in votes.columns else F.lit(1)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("defect"), F.col(k).alias("votes")) for k in PRECEDENCE]))
    return votes.select(*by, n.alias("n"), each.alias("x")).groupBy(*by, "x.defect", "x.votes").agg(F.sum("n").alias("cases")).collect()


def defect_model(votes: DataFrame, known: DataFrame) -> dict[str, tuple[dict[str, float], float]]:
    """For each defect the posterior of every vote pattern and the cutoff that is best on known (planted, votes)."""
    rows, cases = _counted(votes), _counted(known, "planted")
    out = {}
    for k in PRECEDENCE:
        post = posteriors({r["votes"]: r["cases"] for r in rows if r["defect"] == k}, PRIOR[k])
        seen = [(post[r["votes"]], r["cases"], r["planted"] == k) for r in cases if r["defect"] == k and r["votes"] in post]
        out[k] = (post, best_cutoff(seen))
    return out


def flag_defects(messages: DataFrame) -> DataFrame:
    """(msg_id, defect, posterior): every defect of every ai message above its cutoff; several may hold."""
    pairs = materialize(answer_pairs(messages), "pairs")
    shapes = materialize(finished_shapes(pairs), "pair-shapes")
    votes = materialize(voted(pairs.withColumn("sound", F.coalesce(F.expr(_PLANTABLE), F.lit(False))), shapes, ("msg_id", "sound")), "pair-votes")
    known = planted_votes(pairs, shapes)
    as_they_are = votes.where("sound").select(F.lit("").alias("planted"), F.lit(1).cast("bigint").alias("cases"), *PRECEDENCE)
    model = defect_model(votes, known.unionByName(as_they_are))
    release(pairs, shapes)
    flags = []
    for k, (post, cut) in model.items():
        over = {p: v for p, v in post.items() if v >= cut}
        prob = F.lit(None).cast("double")
        if over:
            prob = F.create_map(*[x for p, v in sorted(over.items()) for x in (F.lit(p), F.lit(v))])[F.col(k)]
        flags.append(F.struct(F.lit(k).alias("defect"), prob.alias("posterior")))
    return votes.select("msg_id", F.explode(F.array(*flags)).alias("x")).select("msg_id", "x.defect", "x.posterior").where("posterior is not null")


def found_defects(messages: DataFrame) -> DataFrame:
    """(msg_id, defect): one defect per defective ai message, by PRECEDENCE."""
    flags = flag_defects(messages)
    order = F.create_map(*[x for i, k in enumerate(PRECEDENCE) for x in (F.lit(k), F.lit(i))])[F.col("defect")]
    return flags.groupBy("msg_id").agg(F.min_by("defect", order).alias("defect"))
