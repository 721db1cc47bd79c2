"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelattice.llm import (
    alignment, bpe, chat, collision_search, decontamination, interpolated_lm, licenses, near_duplicates, quality, spelling, toxicity,
    warc, wordpiece,
)
from tradelattice.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judged(toxicity.score(docs, docs, table(spark, folder, "labels")), 0.5)


@query
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.with_ids(docs, public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, "ids", "decoded")
    return coded.select(
        "doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(table(spark, folder, "documents"), near_duplicates.Settings(words=2))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judged(quality.score(docs, docs, table(spark, folder, "labels")), 0.3)


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.score(table(spark, folder, "documents"))


@query
def op4_word_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return wordpiece.with_counts(docs, wordpiece.pieces(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "pieces.*")


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.archive(table(spark, folder, "pages"))
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return warc.read(spark, path, payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


_DIGITS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)"
    for k in range(8) for s in (15, 10, 5, 0)
)
ORACLES["op5_warc"] = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
k as (select *, max(page_id) over (partition by html) as kept from p)
select page_id, strlen(html)::BIGINT as payload_bytes, concat({_DIGITS}) as payload_digest,
  case when page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id <> kept then kept end as refers_to
from k"""


@query
def op8_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    return collision_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs, spelling.Words(drop_one_in=199)))


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


CHECKED_TURN = "</s>[INST] ok [/INST]"


@query
def op13_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHECKED_TURN).alias("text"),
    )
    windows = chat.read(chat.windows(given.unionByName(added)))
    new = F.filter("turns", lambda _, k: k >= F.col("n_repeated"))
    parts = windows.select(
        "conv_id", "first_turn", F.length("text").alias("chars"), F.size(new).alias("turns"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learnt", "").alias("learnt"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("first_turn", "said", "learnt"))).alias("parts"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("learnt")).cast("long").alias("loss_chars"),
        F.sha2(joined("learnt"), 256).alias("loss_sha256"), "formatted_chars",
    )


def _op13_sql(settings: chat.Settings, template: chat.Template) -> str:
    quoted = "|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in template.marks)
    escaped = lambda x: f"length({x}) + len(regexp_extract_all({x}, '{quoted}'))"
    framing = len(template.begin + "\n" + template.end + template.after)
    return rf"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CHECKED_TURN}' union all select -7, 1, 'assistant', '{CHECKED_TURN}'),
costed as (
  select *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]{{1,4}}|[^\p{{L}}\p{{N}}\x00-\x20]')) + {settings.marks} as cost from said),
placed as (
  select *, row_number() over w - 1 as position, sum(cost) over w as stops, sum(cost) over (partition by conv_id) as total
  from costed window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)),
led as (
  select *, coalesce(max(case when position = 0 and role = '{settings.system}' then cost end) over (partition by conv_id), 0) as lead_cost
  from placed),
roomed as (
  select *, stops - lead_cost as ends, stops - lead_cost - cost as begins, {settings.budget} - lead_cost as remaining,
    greatest({settings.budget} - lead_cost - {settings.history}, {settings.budget // 8 + 1}) as room,
    position = 0 and lead_cost > 0 as leads
  from led),
halved as (select *, case when total - lead_cost > greatest(remaining, room) then greatest(room // 2, 1) end as half from roomed),
own as (
  select *, case when half is null then 0 else 2 * (begins // half) + (cost > half)::int end as span
  from halved where half is null or not leads),
starts as (
  select conv_id, span, min(begins) as origin, sum(cost) as fresh from own where half is not null group by conv_id, span),
shown as (
  select conv_id, role, text from own
  union all
  select o.conv_id, o.role, o.text from own o join starts s on o.conv_id = s.conv_id and o.span <> s.span
  where o.half is not null and o.ends <= s.origin and o.begins >= s.origin - least({settings.history}, o.remaining - s.fresh)
  union all
  select h.conv_id, h.role, h.text from halved h join starts s on h.conv_id = s.conv_id where h.leads and h.half is not null),
sized as (
  select conv_id, sum({framing} + {escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")} + {escaped("text")}) as formatted_chars
  from shown group by conv_id),
digests as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
    coalesce(string_agg(text, '' order by position) filter (role in ('assistant')), '') as learnt
  from placed group by conv_id)
select d.conv_id, n_turns, turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars::BIGINT as formatted_chars
from digests d join sized s on d.conv_id is not distinct from s.conv_id"""


ORACLES["op13_chat"] = _op13_sql(chat.Settings(), chat.Template())
