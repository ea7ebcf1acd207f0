"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import chat, exact_dedup, fill_middle, fingerprints, html_extract, media, mixing, near_dedup, packing, quality, secret_scan, token_store, whitening
from voxframe.llm.shared import publish, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(publish(chat.windows(turns), scratch(spark, "chat")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"), stored=True)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_media_columns, op3_secret_scan, op4_best_fit_packing, op5_html_extract, op6_quality, op7_token_store, op8_chat_format, op9_source_mixing, op10_exact_dedup, op11_fingerprints, op12_fill_middle, op13_whitening)
    return {f.__name__: f for f in found}


EXACT_DEDUP = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select *, row_number() over (partition by norm order by length(t) desc, doc_id) as place,
      first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
select doc_id, keep_id, cast(group_size as bigint) as group_size, place = 1 as kept, sha256(norm) as text_sha256 from g
"""


#: Holds while no rate exceeds mixing.PIECE, beyond which a count is the sum of several draws.
SOURCE_MIXING = """
with s as (select source, coalesce(sum(length(text)), 0) as size from documents group by 1), w as (select *, power(size, 0.7e0) as weight from s),
r as (select source, case when size > 0 then sum(size) over () * (weight / sum(case when size > 0 then weight else 0 end) over ()) / size else 1.0e0 end as rate from w),
k as (select source, rate, unnest(range(0, 130)) as k from r), c as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as upto from k),
d as (select *, cast('0x' || substr(md5('mix-1:' || cast(doc_id as varchar) || ':1'), 1, 13) as bigint) / 4503599627370496.0e0 as u from documents),
n as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(count(*) as int) as n_copies from d join c on c.source is not distinct from d.source and c.upto <= d.u group by all),
e as (select *, cast(unnest(range(1, n_copies + 1)) as int) as copy from n)
select doc_id, text, lang, source, n_chars, copy, n_copies, substr(md5('mix-1:order:' || cast(doc_id as varchar) || ':' || cast(copy as varchar)), 1, 16) as shuffle_key from e
"""


#: By code points; the ranks come from the first 32 hexadecimal digits of a digest.
FILL_MIDDLE = """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
d as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || substr(x, 1, 8) as bigint) as h1, cast('0x' || substr(x, 9, 8) as bigint) as h2,
      cast('0x' || substr(x, 17, 8) as bigint) as h3, cast('0x' || substr(x, 25, 8) as bigint) as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substr(t, 1, lo) as prefix, substr(t, lo + 1, hi - lo) as middle, substr(t, hi + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": SOURCE_MIXING, "op10_exact_dedup": EXACT_DEDUP, "op12_fill_middle": FILL_MIDDLE}
