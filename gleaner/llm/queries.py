"""The operators' queries over the given tables and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..sources.tables import read
from . import (chat, decontam, langid, neardup, packing, ppm, quality, repetition, runs, sharding, vptree, warc,
               ztrie)
from .common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ------------------------------------------------------------------------------------------------ language model


@register("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = ppm.score(docs, id_remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


# -------------------------------------------------------------------------------------------------------- packing


@register("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


# ----------------------------------------------------------------------------------------------------------- WARC

#: Base32 of SHA-1: every five hex digits are four characters.
OP3_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, strlen(body)::bigint as payload_bytes, max(page_id) over (partition by h) as top,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '')
           as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to
from d
"""


@register("op3_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    found = warc.pages_of(warc.reassemble(warc.read_records(spark, path)))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


# ---------------------------------------------------------------------------------------------------- chat format

#: The conversation that the contract adds: a user and an assistant row with this text.
PLANTED_CONV, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"

_ESC = r"replace(replace(replace({0}, '\', '\b'), '</turn>', '\e'), '###', '\h')"
OP4_SQL = f"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values ({PLANTED_CONV}, 0, 'user', '{PLANTED_TEXT}'), ({PLANTED_CONV}, 1, 'assistant', '{PLANTED_TEXT}')
), turns as (
  select conv_id, turn, coalesce(role, '') as role, text,
         4 + length(replace({_ESC.format("coalesce(role, '')")}, ':', '\\c')) + 2 + length({_ESC.format('text')}) + 8 as chars
  from rows
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from turns group by conv_id
"""


@register("op4_chat_format", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.lit(PLANTED_CONV).cast("long").alias("conv_id"), F.explode(F.array(
        *[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PLANTED_TEXT).alias("text"))
          for i, r in enumerate(("user", "assistant"))])).alias("x")).select("conv_id", "x.*")
    events = chat.events_from_turns(turns.unionByName(added))
    return chat.digest(chat.render(chat.fold_events(events)))


# ----------------------------------------------------------------------------------------------------- near copies


@register("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


# ---------------------------------------------------------------------------------------------- nearest neighbours

OP6_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select q.vec_id as query_id, v.vec_id, list_distance(q.e, v.e) as score
  from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score, vec_id)::int as rank from d
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@register("op6_nearest_neighbours", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vptree.nearest(vectors, F.col("vec_id") % 100 == 0)


# ---------------------------------------------------------------------------------------------------- language ID


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    scored = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


# ------------------------------------------------------------------------------------------------ decontamination

#: Words of `documents` and `benchmark`; both sides by list position, windows matched on the joined words.
OP8_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
         lambda x: x <> '') as w from benchmark
), sizes as (
  select distinct least(13, len(w)) as size from b where len(w) > 0
), windows as (
  select distinct item_id, least(13, len(w)) as size,
         array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') as phrase
  from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) as t(s) where len(w) > 0
), places as (
  select doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') as phrase
  from d, sizes, unnest(range(1, len(w) - size + 2)) as t(s)
), found as (
  select doc_id, s, places.size, item_id from places join windows using (phrase) where places.size = windows.size
), hits as (
  select doc_id, count(distinct p) as n_hit from found, unnest(range(s, s + size)) as t(p) group by doc_id
), per as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from found) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join per using (doc_id)
"""


@register("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(read(spark, sf_dir, "documents", "doc_id", "text"),
                                        read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontam.contaminated().alias("contaminated"))


# ---------------------------------------------------------------------------------------------- quality classifier


@register("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents, drawn by importance; ``accepted``: not rejected by the classifier."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    weighed = quality.weigh(docs, model).withColumn("accepted", F.col("log_passage") >= F.lit(model.cut))
    return quality.resample(weighed, 0.5, keep=("accepted", "log_passage"))


# ------------------------------------------------------------------------------------------------------- sharding

N_SHARDS = 40


@register("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    placed = sharding.shard_by_bytes(docs, N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------------------------------------------ repetition rules

#: Fixed window lengths stand for the method's limits: a word is covered if a repeated window of `repeat_words` holds it,
#: and a repeat longer than `longest_words` exists if a window one word longer occurs twice.
_LIMITS = repetition.Limits()
OP11_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), tokens as materialized (
  select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as s, len(w) as n from w
), phrases as materialized (
  select rid, s, n, list(word) over (partition by rid order by s rows between current row and 4 following) as w5,
         list(word) over (partition by rid order by s
           rows between current row and {_LIMITS.repeat_words - 1} following) as w_repeat,
         list(word) over (partition by rid order by s
           rows between current row and {_LIMITS.longest_words} following) as w_longest
  from tokens
), windows as (
  select rid, 5 as size, s, w5 as phrase from phrases where s + 4 <= n
  union all
  select rid, {_LIMITS.repeat_words}, s, w_repeat from phrases where s + {_LIMITS.repeat_words - 1} <= n
  union all
  select rid, {_LIMITS.longest_words + 1}, s, w_longest from phrases where s + {_LIMITS.longest_words} <= n
), again as (
  select rid, size, s from windows qualify count(*) over (partition by rid, size, phrase) > 1
), covered as (
  select distinct rid, size, p from again, unnest(range(s, s + size)) as t(p)
), found as (
  select rid, count(*) filter (size = 5) as n_repeat_words,
         sum(length(w[p])) filter (size = {_LIMITS.repeat_words}) as covered_chars,
         count(*) filter (size = {_LIMITS.longest_words + 1}) as too_long
  from covered join w using (rid) group by rid
), f as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(covered_chars, 0)::bigint as covered_chars,
         coalesce(too_long, 0) > 0 as too_long
  from w left join found using (rid)
), b as (
  select *, n_words < {_LIMITS.min_words} or 100 * n_repeat_words > {_LIMITS.window_percent} * n_words as base_failed
  from f
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not too_long and 100 * covered_chars <= {_LIMITS.covered_percent} * word_chars as kept,
       covered_chars
from b
"""


@register("op11_repetition", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(read(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "covered_chars")


# ------------------------------------------------------------------------------------------------------ prefix trie

#: The checksum of an id's decimal digits, from a table that is worked out bit by bit.
_CRC32_TABLE = """
  select list(list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as crc_table
  from range(256) as t(n)
"""
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''),
             lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"""
OP12_SQL = f"""
with crc as materialized ({_CRC32_TABLE}
), turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn is not null, turn, coalesce(role, ''),
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null
), ids as materialized (
  select conv_id, conv_id - conv_id % 100 as base, {_CRC32.format('conv_id::varchar')} % 6 as h
  from (select distinct conv_id from turns), crc
), rebuilt as materialized (
  select conv_id, row_number() over (partition by conv_id order by part, t) as d, sym, chars
  from (select i.conv_id, 0 as part, t, sha256(length(role) || ':' || role || text) as sym, length(text) as chars
        from ids i join turns x on x.conv_id = i.base where t <= h
        union all
        select i.conv_id, 1, t, sha256(length(role) || ':' || role || text), length(text)
        from ids i join turns x on x.conv_id = i.conv_id where t > h)
), steps as materialized (
  select conv_id, 0::bigint as d, sha256('') as node, null as parent, 0 as chars from ids
  union all
  select r.conv_id, r.d, sha256(string_agg(p.sym, '' order by p.d)),
         sha256(coalesce(string_agg(p.sym, '' order by p.d) filter (p.d < r.d), '')), any_value(r.chars)
  from rebuilt r join rebuilt p on p.conv_id = r.conv_id and p.d <= r.d group by r.conv_id, r.d
), ended as (
  select conv_id, arg_max(node, d) as node from steps group by conv_id
), ends as (
  select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from ended group by node
), nodes as materialized (
  select node, d, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
         (count(*) - 1) * any_value(chars) as saved
  from steps group by node, d
), children as (
  select parent as node, count(*) as n_children from nodes where parent is not null group by parent
), full_nodes as materialized (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node)
), below as (
  select s.node, sum(u.saved) as saved_tokens, count(*) filter (u.n_children = 0) as n_leaves
  from full_nodes u join steps s on s.conv_id = u.conv_id and s.d <= u.d group by s.node
)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves,
       saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from full_nodes f left join full_nodes p on p.node = f.parent left join below b on b.node = f.node
     left join ends e on e.node = f.node
"""


@register("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ztrie.turn_digests(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    rebuilt = ztrie.rebuild(turns, id_remainder("conv_id", 6), F.col("conv_id") - F.col("conv_id") % 100)
    return ztrie.prefix_trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                             F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


# ---------------------------------------------------------------------------------------------------- periodic runs


def op13_texts(docs: DataFrame) -> DataFrame:
    """The contract's input: every tenth document, by the checksum of its id, repeats a stretch of its words."""
    words = runs.words_of(F.col("text"))
    n, h = F.size(words), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    from_ = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - from_) / (3 + g % 8))
    repeated = F.array_join(runs.repeat_from(words, from_, period), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


@register("op13_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(op13_texts(read(spark, sf_dir, "documents", "doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ------------------------------------------------------------------------------------------------------- pipeline


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
