"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, chat, divergence, lm, mainpage, mixing, neighbours, periodic, quality, secrets, simhash, tokenfile, urlrules
from riskloom.llm.common import WORD, let, table

QUERIES, ORACLES = {}, {}
WORD_BPE = "word_bpe_49k.json"


def query(make):
    QUERIES[make.__name__] = make
    return make


def hex16(value) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", hex16("fingerprint").alias("fingerprint"), "component_id")


@query
def op3_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards = tokenfile.write_shards(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return tokenfile.read_shards(shards).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    placed, pieces = mixing.mix(table(spark, folder, "documents"))
    return mixing.taken_words(placed, pieces).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query
def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents")).select("doc_id", "_spans", "_more")
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("_spans")), 256).alias("base_sha256"),
        secrets.written(F.sort_array(F.concat("_spans", "_more"))).alias("spans"),
    )


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


@query
def op4_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = mainpage.main_texts(table(spark, folder, "pages").select("page_id", "url", "html"))
    text = F.col("_text").alias("text")
    return found.select("page_id", "url", text, F.char_length("_text").cast("long").alias("n_chars"))


@query
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm.score(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_lm_scoring"] = f"""
with lists as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select r, unnest(w) as w, unnest(range(len(w))) as i from lists),
pairs as (select r, i, w, coalesce(lag(w) over (partition by r order by i), ' ') as p from words),
c1 as (select w, count(*) as n from words group by 1
  union all select ' ', count(*) from lists where len(w) > 0),
c2 as (select p, w, count(*) as n from pairs group by 1, 2 having count(*) >= {lm.LEAST_COUNT}),
scored as (
  select pairs.r, case when c2.n is not null then ln(c2.n / a.n)
    else ln(b.n / (select count(*) from words)) + ln({lm.BACKOFF}::DOUBLE) end as s
  from pairs left join c2 on pairs.p = c2.p and pairs.w = c2.w
  join c1 a on a.w = pairs.p join c1 b on b.w = pairs.w),
sums as (select r, sum(s) as s from scored group by 1)
select doc_id, len(w)::BIGINT as n_words, round(coalesce(s, 0), 4)::DOUBLE as log_score
from lists left join sums using (r)"""


@query
def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op11_source_divergence"] = f"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {LOWER} as t from documents),
words as (
  select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
vocabulary as (
  select lang, term, count(*)::HUGEINT as c from words group by all having count(distinct r) >= {divergence.LEAST_DOCS}),
sizes as (select lang, count(*)::HUGEINT as v, sum(c)::HUGEINT as n from vocabulary group by 1),
found as (select lang, source, term, count(*)::HUGEINT as c from words semi join vocabulary using (lang, term) group by all),
totals as (select lang, source, sum(c)::HUGEINT as n from found group by all),
groups as (select distinct lang, source from docs),
shares as (
  select g.lang, g.source, o.term, coalesce(f.c, 0) as c,
    1 + (1000000000 * (coalesce(f.c, 0) + {divergence.PRIOR})) // (coalesce(t.n, 0) + {divergence.PRIOR} * s.v) as p,
    1 + (1000000000 * (o.c + {divergence.PRIOR})) // (s.n + {divergence.PRIOR} * s.v) as q
  from groups g join vocabulary o using (lang) join sizes s using (lang)
  left join totals t on t.lang = g.lang and t.source = g.source
  left join found f on f.lang = g.lang and f.source = g.source and f.term = o.term),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::BIGINT as value
  from groups a join groups b on a.lang = b.lang and a.source != b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::BIGINT from shares where c > 0 and p > q)
select lang, source, part, item, value,
  row_number() over (partition by lang, source, part order by value desc, item)::INTEGER as rank
from parts qualify part = 'pair' or rank <= {divergence.TERMS}"""


def repeating(key: Column, text: Column) -> Column:
    """The text; that of one key in ten from some word on repeats the words there. Numbers come from the key's CRC32."""
    number = F.crc32(key.cast("string"))
    part = F.floor(number / 10)

    def repeat(words: Column) -> Column:
        first = (part % F.size(words)).cast("int")
        period = (1 + F.floor((F.size(words) - first) / (3 + part % 8))).cast("int")
        own = lambda w, i: F.when(i < first, w).otherwise(F.get(words, first + (i - first) % period))
        return F.when(F.size(words) > 0, F.array_join(F.transform(words, own), " ")).otherwise(text)

    return F.when(number % 10 == 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeat)).otherwise(text)


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"], r["period"], r["length"]))
    found = found.select("*", F.array_min(order).alias("longest"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A conversation whose texts hold marks of other templates and of this one.
HOSTILE = r"\### Assistant: </turn> ok"


@query
def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    formatted = chat.format_chats(rows.unionByName(more))
    read = formatted.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.learned_texts(F.col("formatted"), F.col("loss")), "").alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def in_marks(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '<(\\\\*)({chat.NAMES})', '<\\\\\\1\\2', 'g')"


ORACLES["op12_chat_formatting"] = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, {in_marks('role')} as r, {in_marks('text')} as t
  from (select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '{HOSTILE}' union all select -7, 1, 'assistant', '{HOSTILE}')),
placed as (
  select *, row_number() over w as nth,
    coalesce(lag(role) over w = role, false) as joined
  from rows window w as (partition by conv_id order by turn nulls first, role, text)),
told as (
  select conv_id, count(*)::BIGINT as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
    coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '') as learned,
    sum(length(t) + case when joined then {len(chat.NEXT)}
      else length(r) + {len(chat.OPEN + chat.SAYS + chat.CLOSE + chat.GAP)} end)::BIGINT as formatted_chars
  from placed group by conv_id)
select conv_id, n_turns, turns_sha256, length(learned)::BIGINT as loss_chars, sha256(learned) as loss_sha256, formatted_chars
from told"""
