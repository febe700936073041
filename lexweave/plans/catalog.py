"""Queries over the core operators, each over its whole tables, and the SQL they are checked against.

The SQL is written separately, for another engine (no look-behind, other list functions); columns carry equal names and
types on both sides, whole numbers as BIGINT and scores rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.config import DEFAULT
from lexweave.functions import text as X
from lexweave.operators import ingest as I
from lexweave.operators import memory as M
from lexweave.operators import prompt as P
from lexweave.operators import retrieve as R
from lexweave.operators import sessions as S
from lexweave.runtime import materialize, read_table
from lexweave.sources.files import all_documents, session_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUESTION = "借款合同到期不还，应当怎样收集证据并申请调解？"
RARE = "鼋鼍 zq"
ANSWER = "请先整理合同与付款记录，再向调解组织提出申请。"
SMALL_BUDGET = replace(DEFAULT, max_tokens=200)
CREATED = "2024-01-01 00:00:00"


def _wide(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: _wide(f(lambda name: read_table(spark, d, name)))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -------------------------------------------------------------------------------------------------

W = "[" + X.WS + "]"
NL = "chr(10)"
ART = f"第{X.NUM}{W}*条"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _kind(x: str) -> str:
    return f"case when regexp_matches({x}, '^第{X.NUM}编') then 'p' when regexp_matches({x}, '^第{X.NUM}章') then 'c' when regexp_matches({x}, '^第{X.NUM}节') then 's' when regexp_matches({x}, '^{ART}{W}+') then 'a' else 't' end"


CLEAN = f"""
src as (select upload_id, source, text, received_at, replace(text, chr(13) || {NL}, {NL}) as t0 from uploads where text <> ''),
body as (select *, case when regexp_matches(t0, '\\n第{X.NUM}编') then regexp_extract(t0, '(?s)\\n(第{X.NUM}编.*)$', 1)
  when regexp_matches(t0, '\\n{ART}') then regexp_extract(t0, '(?s)\\n({ART}.*)$', 1) else t0 end as b from src),
raw as (select upload_id, unnest(string_split(b, {NL})) as l0, generate_subscripts(string_split(b, {NL}), 1) as pos from body),
stripped as (select upload_id, pos, {_strip('l0')} as line from raw),
kept as (select *, {_kind('line')} as kind from stripped where line <> '' and not regexp_matches(line, '^目{W}*录{W}*$')
  and not regexp_matches(line, '^中华人民共和国刑法{W}*$') and not regexp_matches(line, '^（[^\\n]*?）$')),
firsts as (select upload_id, min(pos) as fa from kept where kind = 'a' group by 1),
heads as (select k.upload_id, f.fa, max(case when kind = 'p' then pos end) as pp, max(case when kind = 'c' then pos end) as cp, max(case when kind = 's' then pos end) as sp
  from kept k join firsts f on k.upload_id = f.upload_id and k.pos < f.fa group by 1, 2),
bodylines as (
  select k.upload_id, k.pos, k.line from kept k left join firsts f using (upload_id) where f.fa is null or k.pos >= f.fa
  union all select k.upload_id, -3, k.line from kept k join heads h on k.upload_id = h.upload_id and k.pos = h.pp
  union all select k.upload_id, -2, k.line from kept k join heads h on k.upload_id = h.upload_id and k.pos = h.cp and h.cp > coalesce(h.pp, 0)
  union all select k.upload_id, -1, k.line from kept k join heads h on k.upload_id = h.upload_id and k.pos = h.sp and h.sp > coalesce(greatest(h.pp, h.cp), h.pp, h.cp, 0)),
cleaned as (select s.upload_id, s.source, s.received_at, s.text, coalesce(string_agg(line, {NL} order by pos), '') as cleaned from src s left join bodylines using (upload_id) group by all)"""

UNITS = f"""{CLEAN},
broken as (select upload_id, regexp_replace(cleaned, '({ART})({W})', {NL} || '\\1\\2', 'g') as b from cleaned),
ul as (select upload_id, unnest(string_split(b, {NL})) as l0, generate_subscripts(string_split(b, {NL}), 1) as pos from broken),
us as (select upload_id, pos, {_strip('l0')} as line from ul),
uk as (select *, {_kind('line')} as kind from us where line <> ''),
uw as (select *, sum(case when kind = 'a' then 1 else 0 end) over w as unit_ord,
  coalesce(last_value(case when kind = 'p' then line end ignore nulls) over w, '') as part,
  coalesce(last_value(case when kind = 'c' then line when kind = 'p' then '' end ignore nulls) over w, '') as chapter,
  coalesce(last_value(case when kind = 's' then line when kind in ('p', 'c') then '' end ignore nulls) over w, '') as section
  from uk window w as (partition by upload_id order by pos rows unbounded preceding)),
units as (select upload_id, unit_ord::bigint as unit_ord, arg_min(part, pos) as part, arg_min(chapter, pos) as chapter, arg_min(section, pos) as section,
  regexp_extract(arg_min(line, pos), '^({ART})', 1) as article_no, string_agg(line, {NL} order by pos) as text
  from uw where unit_ord > 0 and kind in ('a', 't') group by 1, 2),
ends as (select upload_id, chapter, arg_max(article_no, unit_ord) as article_end from units where chapter <> '' and article_no <> '' group by 1, 2)"""


def _packed(most: int, overlap: int) -> str:
    """Where each possible start ends, then the chain of starts that packing visits."""
    return f"""{UNITS},
nu as (select *, length(text) as len, row_number() over s as i, sum(length(text)) over s as pre, count(*) over (partition by upload_id, chapter, section) as n,
  min(unit_ord) over (partition by upload_id, chapter, section) as scope_ord from units window s as (partition by upload_id, chapter, section order by unit_ord rows unbounded preceding)),
till as (select a.upload_id, a.scope_ord, a.i, a.n, greatest(a.i, coalesce(max(b.i), a.i)) as e from nu a left join nu b
  on a.upload_id = b.upload_id and a.scope_ord = b.scope_ord and b.i >= a.i and b.pre - a.pre + a.len + (b.i - a.i) <= {most} group by 1, 2, 3, 4),
chain as (select upload_id, scope_ord, i, e, n, 1 as chunk_no from till where i = 1
  union all select t.upload_id, t.scope_ord, t.i, t.e, t.n, c.chunk_no + 1 from chain c join till t
  on t.upload_id = c.upload_id and t.scope_ord = c.scope_ord and t.i = case when c.e + 1 - {overlap} > c.i then c.e + 1 - {overlap} else c.i + 1 end),
chunks as (select u.upload_id, u.chapter, u.section, u.scope_ord::bigint as scope_ord, c.chunk_no::bigint as chunk_no, arg_min(u.part, u.i) as part, arg_min(u.article_no, u.i) as article_no,
  arg_max(u.article_no, u.i) as chunk_article_end, count(*)::bigint as n_units, string_agg(u.text, {NL} order by u.i) as text
  from chain c join nu u on u.upload_id = c.upload_id and u.scope_ord = c.scope_ord and u.i between c.i and c.e group by 1, 2, 3, 4, 5)"""


def _qt(q: str) -> str:
    return ", ".join(f"('{c}', {sum(1 for x in q if x == c)})" for c in sorted({c for c in q if not c.isspace()}))


def _bm25(q: str) -> str:
    return f"""
docs as (select doc_id, coalesce(text, '') as text from documents),
toks as (select doc_id, unnest(regexp_extract_all(text, '[^{X.WS}]')) as token from docs),
tf as (select doc_id, token, count(*) as tf from toks group by 1, 2),
dl as (select d.doc_id, length(regexp_replace(text, '{W}+', '', 'g'))::double as dl from docs d),
n as (select count(*)::double as n, avg(dl) as avgdl from dl),
df as (select token, count(*)::double as df from tf group by 1),
rawidf as (select token, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from df, n),
idf as (select token, case when raw < 0 then (select avg(raw) from rawidf) * 0.25::double else raw end as idf from rawidf),
q(token, times) as (values {_qt(q)}),
part as (select tf.doc_id, sum(q.times * i.idf * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * dl.dl / n.avgdl))) as s
  from tf join q using (token) join idf i using (token) join dl using (doc_id), n group by 1),
scored as (select d.doc_id, round(coalesce(s, 0), 6) as score from docs d left join part using (doc_id)),
bm25 as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from scored qualify rank <= 20)"""


_DIST = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6)"
VECTOR = f"""
near as (select e.vec_id, {_DIST} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q),
vec as (select vec_id, distance, row_number() over (order by distance, vec_id) as rank from near qualify rank <= 20)"""
HYBRID = f"""{_bm25(QUESTION)}, {VECTOR},
lists as (select vec_id as doc_id, 0 as l, rank from vec union all select doc_id, 1 as l, rank from bm25),
fused as (select doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, min({{'l': l, 'r': rank}}) as seen from lists group by 1),
hybrid as (select doc_id, rrf_score, row_number() over (order by rrf_score desc, seen) as rank from fused qualify rank <= 6)"""

ONCE = """
once as (select session_id, pos, arg_min(case type when 'user' then 'human' when 'assistant' then 'ai' else type end, msg_id) as type, arg_min({'c': content}, msg_id).c as content from history_store
  where session_id is not null and pos is not null group by 1, 2)"""
# After a turn: every session's messages with a question and an answer behind its last position.
APPENDED = f"""{ONCE.replace("once as", "before as")},
once as (select * from before union all select session_id, max(pos) + 1, 'human', '{QUESTION}' from before group by 1 union all select session_id, max(pos) + 2, 'ai', '{ANSWER}' from before group by 1)"""

ROUNDS = """,
summ as (select * from once where type = 'system' and coalesce(starts_with(content, '[SESSION_SUMMARY]'), false)),
normal as (select * from once where not (type = 'system' and coalesce(starts_with(content, '[SESSION_SUMMARY]'), false)) or type is null),
rn as (select *, row_number() over (partition by session_id order by pos) as k from normal),
rounds as (select session_id, pos, type, content, (sum(case when type = 'human' and k > 1 then 1 else 0 end) over (partition by session_id order by pos rows unbounded preceding))::bigint as round_id from rn),
totals as (select session_id, max(round_id) + 1 as total_rounds from rounds group by 1)"""
MEM = ONCE + ROUNDS

_TOK = "greatest(length(coalesce({c}, '')) // 2, 1) + 6"


def _memory(budget: int, stored: str = MEM) -> str:
    line = "'[' || case type when 'human' then '用户' when 'ai' then '助手' else '系统' end || '] ' || coalesce(content, '')"
    return f"""{stored},
olds as (select session_id, {_strip("replace(arg_max(content, pos), '[SESSION_SUMMARY]', '')")} as old_summary from summ group by 1),
trans as (select session_id, string_agg({line}, '\\n' order by pos) as t from rounds join totals using (session_id) where total_rounds >= 5 and round_id < total_rounds - 3 group by 1),
ids as (select session_id from totals union select session_id from olds),
state as (select i.session_id, coalesce(total_rounds, 0)::bigint as total_rounds, t is not null as triggered,
  case when t is not null then left({_strip("concat_ws('\\n', nullif(coalesce(old_summary, ''), ''), nullif(t, ''))")}, 1500) else coalesce(old_summary, '') end as summary
  from ids i left join totals using (session_id) left join olds using (session_id) left join trans using (session_id)),
per as (select session_id, round_id, sum({_TOK.format(c='content')})::bigint as tokens, any_value(case when summary <> '' then {_TOK.format(c="'[SESSION_SUMMARY]\\n' || summary")} else 0 end)::bigint as head
  from rounds join state using (session_id) where round_id >= total_rounds - 3 group by 1, 2),
cum as (select *, sum(tokens) over w as upto, row_number() over w as n from per window w as (partition by session_id order by round_id desc rows unbounded preceding)),
kept as (select session_id, round_id, tokens, head from cum where n = 1 or head + upto <= {budget}),
compressed as (select session_id, -1::bigint as ord, 'system' as type, '[SESSION_SUMMARY]\\n' || summary as content from state where summary <> ''
  union all select session_id, pos as ord, type, content from rounds join kept using (session_id, round_id))"""


# --- ingestion -----------------------------------------------------------------------------------------------------


def _cleaned(t) -> DataFrame:
    return t("uploads").where("text <> ''").withColumn("cleaned", I.clean_text(F.col("text")))


@query(f"with {CLEAN} select upload_id, cleaned, md5(cleaned) as md5 from cleaned")
def clean_documents(t):
    return _cleaned(t).select("upload_id", "cleaned", X.md5_hex(F.col("cleaned")).alias("md5"))


@query(f"with {CLEAN} select upload_id, pos::bigint as pos, line, kind from kept")
def clean_lines(t):
    # Positions count all lines of the body, so they agree with a numbering before blanks and noise go.
    d = t("uploads").where("text <> ''").select("upload_id", F.posexplode(F.split(X.body_start(X.unix_lines(F.col("text"))), "\n")).alias("p", "l"))
    d = d.select("upload_id", (F.col("p") + 1).alias("pos"), X.strip(F.col("l")).alias("line")).where("line <> ''")
    return d.where(~I.X.is_noise(F.col("line"), DEFAULT.title_lines)).withColumn("kind", X.line_kind(F.col("line")))


@query("""with h as (select upload_id, source, received_at, md5(text) as md5 from uploads where text is not null)
select upload_id, source, md5 from (select *, row_number() over (partition by md5 order by received_at nulls first, upload_id) as n from h where md5 not in (select md5 from fingerprints where md5 is not null)) where n = 1""")
def upload_fingerprint_dedup(t):
    u = t("uploads").where("text is not null").withColumn("md5", X.md5_hex(F.col("text")))
    return I.new_documents(u, t("fingerprints"), "upload_id", ["received_at"]).select("upload_id", "source", "md5")


@query("""select md5(text) as md5, min(doc_id) as first_id, count(*) as copies from documents where text is not null group by 1""")
def doc_fingerprints(t):
    return t("documents").where("text is not null").groupBy(X.md5_hex(F.col("text")).alias("md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"""with {UNITS}, h as (select upload_id, received_at, md5(coalesce(text, '')) as md5, upload_id in (select upload_id from units) as has_units from uploads),
f as (select *, row_number() over (partition by md5 order by received_at nulls first, upload_id) as n from h)
select upload_id, md5, case when md5 in (select md5 from fingerprints) or (has_units and n > 1) then 'repeat' when not has_units then 'warn' else 'success' end as status from f""")
def ingest_status(t):
    return I.ingest_status(t("uploads"), t("fingerprints"), hash_of="raw")


_STORED_SQL = f"""with recursive {_packed(600, 0)}, h as (select upload_id, received_at, md5(coalesce(text, '')) as md5 from uploads),
fresh as (select upload_id from h where md5 not in (select lower(trim(md5)) from fingerprints where md5 is not null) qualify row_number() over (partition by md5 order by received_at nulls first, upload_id) = 1)
select c.*, coalesce(e.article_end, c.chunk_article_end) as article_end, coalesce(s.source, '') as source, '' as operator, '{CREATED}' as create_time
from chunks c join fresh using (upload_id) left join ends e using (upload_id, chapter) join uploads s using (upload_id)"""


@query(_STORED_SQL)
def ingest_chunks(t):
    # The whole upload driver: clean, drop what the registry holds, structure, pack, describe; empty uploads give nothing.
    return I.ingest(t("uploads"), t("fingerprints"), create_time=CREATED, hash_of="raw")


@query(f"with {UNITS} select * from units")
def legal_units(t):
    return I.article_units(_cleaned(t), "upload_id", "cleaned")


@query(f"with {UNITS} select * from ends")
def chapter_ends(t):
    return I.chapter_ends(I.article_units(_cleaned(t), "upload_id", "cleaned"), "upload_id")


@query(f"with recursive {_packed(600, 0)} select * from chunks")
def chunk_greedy_pack(t):
    return I.pack_chunks(I.article_units(_cleaned(t), "upload_id", "cleaned"), "upload_id")


@query(f"with recursive {_packed(600, 1)} select * from chunks")
def chunk_overlap_pack(t):
    return I.pack_chunks_overlapping(I.article_units(_cleaned(t), "upload_id", "cleaned"), "upload_id", 600, 1)


def _chunks(t) -> DataFrame:
    docs = _cleaned(t)
    units = I.article_units(docs, "upload_id", "cleaned")
    return I.with_metadata(I.pack_chunks(units, "upload_id"), units, docs, "upload_id", create_time=CREATED)


_CHUNKS_SQL = f"""with recursive {_packed(600, 0)}, full_chunks as (select c.*, coalesce(e.article_end, c.chunk_article_end) as article_end, s.source, '' as operator, '{CREATED}' as create_time
from chunks c left join ends e using (upload_id, chapter) join src s using (upload_id))"""


@query(f"{_CHUNKS_SQL} select * from full_chunks")
def legal_chunks(t):
    return _chunks(t)


@query(f"{_CHUNKS_SQL} select upload_id, scope_ord, chunk_no, ((row_number() over (partition by upload_id order by scope_ord, chunk_no) - 1) // 10)::bigint as batch from full_chunks")
def insert_batches(t):
    return I.insert_batches(_chunks(t), "upload_id", ["scope_ord", "chunk_no"]).select("upload_id", "scope_ord", "chunk_no", "batch")


@query(f"""with {CLEAN}, ls as (select upload_id, unnest(string_split(cleaned, {NL})) as l0, generate_subscripts(string_split(cleaned, {NL}), 1) as pos from cleaned),
ll as (select upload_id, pos, {_strip('l0')} as line from ls),
lc as (select *, regexp_matches(line, '^第{X.NUM}章') as is_c, last_value(case when regexp_matches(line, '^第{X.NUM}章') then line end ignore nulls) over (partition by upload_id order by pos rows unbounded preceding) as chapter,
  regexp_extract_all(line, '{ART}') as nos from ll where line <> '')
select upload_id, chapter, arg_max({_strip('nos[len(nos)]')}, pos) as article_end from lc where not is_c and chapter is not null and len(nos) > 0 group by 1, 2""")
def line_chapter_ends(t):
    return I.line_chapter_ends(_cleaned(t), "upload_id", "cleaned")


@query(f"""{_CHUNKS_SQL}, cl as (select upload_id, scope_ord, chunk_no, text, scope_ord * 100000 + chunk_no as ord, regexp_extract_all(text, '{ART}') as nos from full_chunks),
cw as (select *, last_value(case when len(nos) > 0 then nos[len(nos)] end ignore nulls) over (partition by upload_id order by ord rows unbounded preceding) as carry from cl)
select upload_id, scope_ord, chunk_no, coalesce(nos[1], carry, '') as article_no, coalesce(nos[len(nos)], '') as chunk_article_end, '' as part, '' as chapter, '' as section, coalesce(nos[len(nos)], '') as article_end from cw""")
def carried_metadata(t):
    # Packed chunks hold no heading lines, so only article labels are found and carried.
    c = _chunks(t).select("upload_id", "scope_ord", "chunk_no", "text", (F.col("scope_ord") * 100000 + F.col("chunk_no")).alias("ord"))
    ends = I.line_chapter_ends(_cleaned(t), "upload_id", "cleaned")
    out = I.carried_metadata(c, "upload_id", "ord", ends)
    return out.select("upload_id", "scope_ord", "chunk_no", "article_no", "chunk_article_end", "part", "chapter", "section", "article_end")


_PLAIN = 240


def _last(kind: str) -> str:
    m = f"regexp_extract_all(text, '(?m)^第{X.NUM}{kind}{W}*[^\\n]*$')"
    return f"{_strip(f'({m})[len({m})]')}"


@query(f"""with {CLEAN}, pl as (select upload_id, unnest(generate_series(0, (length(cleaned) - 1) // {_PLAIN})) as ord, cleaned from cleaned where cleaned <> ''),
pt as (select upload_id, ord::bigint as ord, substr(cleaned, ord::int * {_PLAIN} + 1, {_PLAIN}) as text from pl),
found as (select *, {_last('编')} as p, {_last('章')} as c, {_last('节')} as s, regexp_extract_all(text, '{ART}') as nos from pt),
carried as (select upload_id, ord, nos, coalesce(last_value(p ignore nulls) over w, '') as part,
  coalesce(last_value(case when c is not null then c when p is not null then '' end ignore nulls) over w, '') as chapter,
  coalesce(last_value(case when s is not null then s when p is not null or c is not null then '' end ignore nulls) over w, '') as section,
  last_value(case when len(nos) > 0 then {_strip('nos[len(nos)]')} end ignore nulls) over w as carry from found window w as (partition by upload_id order by ord rows unbounded preceding)),
ls as (select upload_id, unnest(string_split(cleaned, {NL})) as l0, generate_subscripts(string_split(cleaned, {NL}), 1) as pos from cleaned),
ll as (select upload_id, pos, {_strip('l0')} as line from ls),
lc as (select *, regexp_matches(line, '^第{X.NUM}章') as is_c, last_value(case when regexp_matches(line, '^第{X.NUM}章') then line end ignore nulls) over (partition by upload_id order by pos rows unbounded preceding) as chapter,
  regexp_extract_all(line, '{ART}') as nos from ll where line <> ''),
ce as (select upload_id, chapter, arg_max({_strip('nos[len(nos)]')}, pos) as e from lc where not is_c and chapter is not null and len(nos) > 0 group by 1, 2)
select upload_id, ord, part, chapter, section, coalesce({_strip('nos[1]')}, carry, '') as article_no, coalesce({_strip('nos[len(nos)]')}, '') as chunk_article_end,
  coalesce(nullif(e, ''), {_strip('nos[len(nos)]')}, '') as article_end from carried left join ce using (upload_id, chapter)""")
def legacy_metadata(t):
    # Texts cut by length, with their headings: what is carried, reset and joined by chapter shows here.
    docs = _cleaned(t)
    out = I.carried_metadata(I.plain_chunks(docs, "upload_id", "cleaned", _PLAIN), "upload_id", "ord", I.line_chapter_ends(docs, "upload_id", "cleaned"))
    return out.select("upload_id", "ord", "part", "chapter", "section", "article_no", "chunk_article_end", "article_end")


@query("select " + ", ".join(f"coalesce({c}, '') as {c}" for c in ("source", "part", "chapter", "section", "article_no", "article_end", "chunk_article_end", "text", "operator", "create_time")) + ", chunk_id, ingested_at from legal_chunker")
def stored_chunks(t):
    return all_documents(t("legal_chunker"))


# --- retrieval -----------------------------------------------------------------------------------------------------


@query(f"with toks as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^{X.WS}]')) as token from documents), one as (select doc_id, token, count(*) as n from toks group by 1, 2) select token, sum(n)::bigint as tf, count(*) as df from one group by 1")
def char_term_stats(t):
    return R.term_statistics(t("documents"))


@query(f"with {_bm25(QUESTION)} select * from bm25")
def bm25_topk(t):
    return R.bm25_top(t("documents"), QUESTION)


@query(f"""with docs as (select doc_id, coalesce(text, '') as text from documents),
toks as (select doc_id, unnest(regexp_extract_all(text, '[^{X.WS}]')) as token from docs),
tf as (select doc_id, token, count(*) as tf from toks group by 1, 2),
dl as (select doc_id, sum(tf)::double as dl from tf group by 1),
n as (select (select count(*) from docs)::double as n, (select sum(tf) from tf)::double / (select count(*) from docs) as avgdl),
df as (select token, count(*)::double as df from tf group by 1),
rawidf as (select token, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from df, n),
idf as (select token, case when raw < 0 then (select avg(raw) from rawidf) * 0.25::double else raw end as idf from rawidf),
qt as (select item_id, unnest(regexp_extract_all(question, '[^{X.WS}]')) as token from eval_items where question is not null),
q as (select item_id, token, count(*) as times from qt group by 1, 2),
scored as (select item_id, tf.doc_id, round(sum(q.times * i.idf * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * dl.dl / n.avgdl))), 6) as score
  from tf join q using (token) join idf i using (token) join dl using (doc_id), n group by 1, 2)
select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored qualify rank <= 20""")
def bm25_topk_batch(t):
    index = materialize(R.character_index(t("documents")), "character-index")
    return R.bm25_top_batch(index, t("eval_items"), question_key="item_id")


@query(f"with {_bm25(RARE)} select * from bm25")
def bm25_topk_zero_fill(t):
    return R.bm25_top(t("documents"), RARE)


def _first_vector(t) -> list[float]:
    return list(t("embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"with {VECTOR} select * from vec")
def vector_topk(t):
    return R.vector_top(t("embeddings"), _first_vector(t))


@query(f"with {VECTOR} select * from vec where rank <= 5")
def vector_retriever(t):
    return R.vector_top(t("embeddings"), _first_vector(t), DEFAULT.retriever_k)


@query(f"""with near as (select e.vec_id, {_DIST} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label = 1)
select vec_id, distance, row_number() over (order by distance, vec_id) as rank from near qualify rank <= 20""")
def vector_topk_filtered(t):
    return R.vector_top(t("embeddings").where("label = 1"), _first_vector(t))


@query(f"""with near as (select q.vec_id as query_id, e.vec_id, {_DIST} as distance from embeddings e, embeddings q where q.vec_id % 50 = 0)
select query_id, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id) as rank from near qualify rank <= 20""")
def vector_topk_batch(t):
    e = t("embeddings")
    return R.vector_top_batch(e, e.where("vec_id % 50 = 0"))


@query(f"""with {_bm25(QUESTION)}, {VECTOR},
l as (select vec_id as doc_id, 0 as l, rank, distance as value from vec union all select doc_id, 1 as l, rank, score as value from bm25)
select doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, arg_max(value, l * 1000 + rank) as value, row_number() over (order by round(sum(1.0::double / (60 + rank)), 9) desc, min(l * 1000 + rank)) as rank from l group by 1""")
def rrf_fusion(t):
    # Both whole ranked lists, with a column carried along from the list seen last.
    near = R.vector_top(t("embeddings"), _first_vector(t)).select(F.col("vec_id").alias("doc_id"), "rank", F.col("distance").alias("value"))
    words = R.bm25_top(t("documents"), QUESTION).select("doc_id", "rank", F.col("score").alias("value"))
    return R.rrf_fuse([near, words], ["doc_id"], DEFAULT.vector_k + DEFAULT.bm25_k, carry=["value"])


def _hybrid(t) -> DataFrame:
    # Vectors carry document ids: the vector of document n has vec_id n.
    recall = R.HybridRetriever(
        lambda q, k: R.vector_top(t("embeddings"), _first_vector(t), k).withColumnRenamed("vec_id", "doc_id"),
        lambda q, k: R.bm25_top(t("documents"), q, k),
        ["doc_id"],
    )
    return recall.retrieve(QUESTION)


@query(f"with {HYBRID} select * from hybrid")
def hybrid_search(t):
    return _hybrid(t)


_OF = "(select source from legal_chunker where source is not null group by 1 order by count(*) desc, 1 limit 1)"
_KEY = "concat_ws('|', coalesce(source, ''), coalesce(chapter, ''), coalesce(article_no, ''), coalesce(chunk_article_end, ''), left(coalesce(text, ''), 120))"


@query(f"""with documents as (select chunk_id as doc_id, * from legal_chunker where source = {_OF}), {_bm25(QUESTION)},
near as (select d.doc_id, {_DIST} as distance from embeddings e join documents d on d.doc_id = e.vec_id, (select embedding from embeddings where vec_id = 0) q),
vec as (select doc_id, row_number() over (order by distance, doc_id) as rank from near qualify rank <= 20),
lists as (select doc_id, 0 as l, rank from vec union all select doc_id, 1 as l, rank from bm25),
fused as (select {_KEY} as doc_key, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, min({{'l': l, 'r': rank}}) as seen, arg_max(text, {{'l': l, 'r': rank}}) as text
  from lists join (select doc_id, source, chapter, article_no, chunk_article_end, text from documents) using (doc_id) group by 1)
select doc_key, rrf_score, text, row_number() over (order by rrf_score desc, seen) as rank from fused qualify rank <= 6""")
def hybrid_by_source(t):
    # One source only, chunks told apart by their document key: stored copies of a chunk are one result.
    c = t("legal_chunker")
    most = c.where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").first()
    cfg = replace(DEFAULT, source_filter=most["source"] if most else "")
    d = R.by_source(c, cfg).select("chunk_id", R.document_key(F.col("source"), F.col("chapter"), F.col("article_no"), F.col("chunk_article_end"), F.col("text")).alias("doc_key"), "text")
    query = _first_vector(t)
    near = lambda q, k: R.vector_top(t("embeddings").join(d.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi"), query, k).withColumnRenamed("vec_id", "chunk_id").join(d, "chunk_id")
    words = lambda q, k: R.bm25_top(d, q, k, "chunk_id").join(d, "chunk_id")
    return R.HybridRetriever(near, words, ["doc_key"], ["text"], cfg).retrieve(QUESTION)


_EVID = """h as (select hybrid.rank, coalesce(d.source, '') as source, coalesce(d.statute, '') as chapter, coalesce(d.lang, '') as article_no, coalesce(d.text, '') as text from hybrid left join documents d using (doc_id)),
ctx as (select string_agg('source=' || source || ' chapter=' || chapter || ' article=' || article_no || '\\n原文片段：' || text, '\\n\\n' order by rank) as context from h)"""


def _evidence(t) -> DataFrame:
    d = t("documents").select("doc_id", "source", F.col("statute").alias("chapter"), F.col("lang").alias("article_no"), "text")
    return P.evidence(_hybrid(t).join(d, "doc_id", "left"))


@query(f"with {HYBRID}, {_EVID} select context from ctx")
def evidence_context(t):
    return _evidence(t)


@query(f"""with {HYBRID}, {_EVID} select '{P.TEMPLATE.replace("{sep}", chr(92) + "n").split("{context}")[0]}' || context || {NL} || '问题：{QUESTION}' as prompt from ctx""")
def prompt_render(t):
    return _evidence(t).select(P.render(F.col("context"), F.lit(QUESTION)).alias("prompt"))


# --- memory --------------------------------------------------------------------------------------------------------


@query(f"with {MEM} select session_id, count(*) as messages, sum({_TOK.format(c='content')})::bigint as tokens from once group by 1")
def message_tokens(t):
    return M.stored_once(t("history_store")).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(X.message_tokens(F.col("content"))).alias("tokens"))


@query(f"with {MEM} select session_id, pos, round_id from rounds")
def session_rounds(t):
    return M.rounds(t("history_store")).select("session_id", "pos", "round_id")


@query(f"with {MEM} select session_id, pos, round_id from rounds join totals using (session_id) where round_id >= total_rounds - 3")
def memory_window(t):
    h = t("history_store")
    return M.rounds(h).join(M.session_rounds(h), "session_id").where(F.col("round_id") >= F.col("rounds") - DEFAULT.keep).select("session_id", "pos", "round_id")


@query(f"with {_memory(4000)} select session_id, total_rounds, triggered, summary from state")
def memory_fallback_summary(t):
    return M.memory_state(t("history_store"))


@query(f"with {_memory(200)} select * from kept")
def memory_budget_trim(t):
    h = t("history_store")
    return M.kept_rounds(h, M.memory_state(h, SMALL_BUDGET), SMALL_BUDGET)


@query(f"with {_memory(4000)} select * from compressed")
def memory_compress(t):
    return M.compress(t("history_store"))


def _turn(t) -> DataFrame:
    """A question and its answer for every session stored."""
    some = t("history_store").where("session_id is not null and pos is not null").select("session_id").distinct()
    two = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("type"), F.lit(c).alias("content")) for i, (k, c) in enumerate((("human", QUESTION), ("ai", ANSWER)))])
    return some.select("session_id", F.explode(two).alias("m")).select("session_id", "m.*")


@query(f"with {APPENDED} select session_id, pos, type, content from once")
def history_append(t):
    return M.append_messages(t("history_store"), _turn(t)).select("session_id", "pos", "type", "content")


@query(f"with {_memory(4000, APPENDED + ROUNDS)} select session_id, to_json(list({{'type': type, 'data': {{'content': coalesce(content, ''), 'type': type}}}} order by ord))::varchar as json from compressed group by 1")
def history_after_turn(t):
    # What a turn leaves in each session's file: read, append, compress, written anew.
    return session_json(M.add_messages(t("history_store"), _turn(t)))


_LINE = "'[' || case type when 'human' then '用户' when 'ai' then '助手' else '系统' end || '] ' || coalesce(content, '')"


@query(f"""with {HYBRID}, {_EVID}, {_memory(4000)}, past as (select session_id, string_agg({_LINE}, {NL} order by ord) as history from compressed group by 1)
select session_id, '{P.TEMPLATE.replace("{sep}", chr(92) + "n").split("{context}")[0]}' || context || {NL} || case when coalesce(history, '') <> '' then history || {NL} else '' end || '问题：{QUESTION}' as prompt
from (select distinct session_id from once) left join past using (session_id), ctx""".replace("select * from _", ""))
def session_prompts(t):
    asked = t("history_store").where("session_id is not null and pos is not null").select("session_id").distinct().withColumn("question", F.lit(QUESTION))
    return P.session_prompts(t("history_store"), asked, _evidence(t)).select("session_id", "prompt")


# --- sessions ------------------------------------------------------------------------------------------------------


@query(f"""with hm as (select session_id, arg_min(content, pos * 1000000000 + msg_id) as c from history_store where type in ('human', 'user') and content is not null and session_id is not null group by 1)
select s.session_id, coalesce(nullif(left({_strip('c')}, 15), ''), '新会话') as label from (select distinct session_id from history_store where session_id is not null) s left join hm using (session_id)""")
def session_label(t):
    return S.session_labels(t("history_store"))


_PINS = "select session_id, coalesce(arg_max({'p': pinned}, {'a': coalesce(updated_at, timestamp '1000-01-01'), 'b': coalesce(pinned, false)}).p, false) as pinned from session_meta where session_id is not null group by 1"


@query(f"with p as ({_PINS}), s as (select session_id, max(stored_at) as last_stored from history_store where starts_with(session_id, 'chat_') group by 1) select session_id, coalesce(pinned, false) as pinned, last_stored from s left join p using (session_id)")
def session_list(t):
    return S.list_sessions(t("history_store"), t("session_meta"))


@query("select session_id, count(*) % 2 = 1 as pinned from session_meta where session_id is not null group by 1")
def pin_toggle(t):
    return S.toggled_pins(t("session_meta"))


@query(f"with p as ({_PINS}) select session_id, case when session_id in (select session_id from history_store) then not pinned else pinned end as pinned from (select * from p union all select distinct session_id, false from history_store where session_id is not null and session_id not in (select session_id from p))")
def pin_turned_over(t):
    return S.toggle(t("session_meta"), t("history_store").where("session_id is not null"))


@query("select h.msg_id, h.session_id from history_store h where not exists (select 1 from session_meta m where m.session_id = h.session_id and m.pinned and regexp_full_match(m.session_id, 'chat_[0-9a-f]{12}'))")
def session_delete(t):
    return S.delete_sessions(t("history_store"), t("session_meta").where("pinned")).select("msg_id", "session_id")


@query(f"""with {MEM}, seen as (select session_id, pos, case when type = 'human' then 'user' else 'assistant' end as role, coalesce(content, '') as content from normal)
select * from seen union all select distinct session_id, 0::bigint, 'assistant', '{DEFAULT.greeting}' from once where session_id not in (select session_id from seen)""")
def ui_history(t):
    return S.display_history(t("history_store"))


_LIST = f"p as ({_PINS}), s as (select session_id, max(stored_at) as last_stored from history_store where starts_with(session_id, 'chat_') group by 1), sl as (select session_id, coalesce(pinned, false) as pinned, last_stored from s left join p using (session_id))"


@query(f"with {_LIST} select *, row_number() over (order by pinned desc, last_stored desc nulls last, lower(session_id), session_id) as place from sl")
def session_places(t):
    return S.placed_sessions(t("history_store"), t("session_meta"))


@query(f"""with {_LIST}, hm as (select session_id, arg_min(content, pos * 1000000000 + msg_id) as c from history_store where type in ('human', 'user') and content is not null and session_id is not null group by 1)
select session_id, pinned, last_stored, coalesce(nullif(left({_strip('c')}, 15), ''), '新会话') as label, session_id = 'chat_000000000000' as active from sl left join hm using (session_id)""")
def session_sidebar(t):
    return S.sidebar(t("history_store"), t("session_meta"), "chat_000000000000")


@query(f"with {_LIST} select session_id, pinned, last_stored, 1::bigint as place from sl union all select 'chat_000000000000', false, null, 0 where 'chat_000000000000' not in (select session_id from sl)")
def session_active(t):
    return S.with_active(S.list_sessions(t("history_store"), t("session_meta")), "chat_000000000000")


@query("""with log as (select session_id, case when pinned then 'pin' when not pinned then 'unpin' else 'delete' end as act, updated_at as ts from session_meta where session_id is not null and updated_at is not null),
one as (select session_id, ts, max(act) as act from log group by 1, 2),
ends as (select session_id, arg_max(act, ts) as final, arg_max(act, ts) filter (act <> 'delete') as pin from one group by 1)
select session_id, pin = 'pin' as pinned from ends where final <> 'delete' and pin is not null""")
def session_actions(t):
    # Each row of the metadata read as an action; of actions at one time the last by name counts.
    m = t("session_meta").where("session_id is not null and updated_at is not null")
    log = m.select("session_id", F.when(F.col("pinned"), "pin").when(~F.col("pinned"), "unpin").otherwise("delete").alias("action"), F.col("updated_at").alias("at"))
    log = log.groupBy("session_id", "at").agg(F.max("action").alias("action"))
    return S.apply_actions(t("session_meta").limit(0), log)[0]
