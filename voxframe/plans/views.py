"""Timed segments, activity frames, windows and labelled vectors made from the tables of a directory.

`SQL` has the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = {
    "v_seg": """select conv_id recording_id, turn input_index, role speaker, text, dur_ms,
        cast(sum(dur_ms+gap_ms) over (partition by conv_id order by turn) - dur_ms - gap_ms + 1000 as bigint) start_ms,
        cast(sum(dur_ms+gap_ms) over (partition by conv_id order by turn) - gap_ms + 1000 as bigint) end_ms
        from (select *, cast(400+20*length(text) as bigint) dur_ms, cast(100*(((turn*7+conv_id)%11)-2) as bigint) gap_ms from conversations) t""",
    "v_hyp": """select *, case when (input_index*5+recording_id)%7=0 then 'unknown' when input_index%4=3 then 'local_spk_0' when speaker='user' then 'local_spk_1' else 'local_spk_2' end as label from v_seg""",
    "v_frame": """select user_id recording_id, event_id, cast((row_number() over (partition by user_id order by ts,event_id)-1)*500 as bigint) start_ms,
        cast(row_number() over (partition by user_id order by ts,event_id)*500 as bigint) end_ms,
        case event_type when 'error' then 0 when 'purchase' then 2 else 1 end active,
        case event_type when 'click' then 'speaker_0' when 'view' then 'speaker_1' when 'signup' then 'speaker_2' when 'purchase' then 'speaker_0' else '' end dom from events""",
    "v_win": """select event_id, user_id recording_id, 500+(event_id*37)%5000 duration_ms, (40+k*0.7e0)/100 speech_ratio,
        case when event_id%29=0 then 50 else 0 end overlap_ms, case when event_id%31=0 then 1 else 0 end change_point_count,
        case when event_id%43=0 then null else -60+value/8 end loudness_db, (event_id%20)*1.0e0 loudness_std_db, (event_id*13)%200 left_sil, (event_id*17)%200 right_sil,
        case when event_id%23=0 then ['tiny_interval','unstable_loudness'] when event_id%19=0 then ['residual_overlap'] when event_id%17=0 then ['low_speech_ratio'] else []::varchar[] end flags,
        (event_id%7)*1000 start_ms, (event_id%7)*1000 + 500+(event_id*37)%5000 end_ms
        from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) k from events) t""",
    "v_gold": """select vec_id%5+5*(label//5) recording_id, vec_id, label, embedding::double[] u, case when vec_id%3=0 then 0.7e0 else 1.0e0 end weight, 1000+(vec_id*37)%5000 start_ms, 1000+(vec_id*53)%4000 duration_ms, case when vec_id%11=0 then null else -60.0e0+vec_id%37 end loudness_db from embeddings where vec_id%7<4""",
    "v_sent": """select vec_id%5+5*(label//5) + case when vec_id%41=0 then 1000 else 0 end recording_id, vec_id, case when vec_id%23=0 then null else embedding::double[] end u, 1000+(vec_id*97)%7000 duration_ms, 0.4e0+(vec_id%60)/100.0e0 speech_ratio, (vec_id%20)*1.0e0 loudness_std_db, -60.0e0+vec_id%40 loudness_db from embeddings where vec_id%7>=4""",
    "v_task": """select lower(md5(cast(o_orderkey as varchar))) task_id, o_orderkey, case o_orderstatus when 'F' then case when o_orderkey%3=0 then 'failed' else 'succeeded' end when 'O' then case when o_orderkey%2=0 then 'queued' else 'running' end else case when o_orderkey%2=0 then 'cancelled' else 'expired' end end status,
        epoch_ms(o_orderdate) created_at_ms, epoch_ms(o_orderdate) + 60000 finished_at_ms, epoch_ms(o_orderdate) + 120000 expired_at_ms,
        case when o_orderkey%13=0 then epoch_ms(o_orderdate) + 30000 end cancel_requested_at_ms, case when o_orderkey%5=0 then 'cloud_asr' else 'segments' end input_mode,
        case when o_orderkey%4<>0 then 'key-' || cast(o_custkey as varchar) end idempotency_key, cast(o_orderkey%3 as varchar) input_digest from orders""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("input_index"), F.col("role").alias("speaker"), "text", (400 + 20 * F.length("text")).cast("long").alias("dur_ms"), (100 * (((F.col("turn") * 7 + F.col("conv_id")) % 11) - 2)).cast("long").alias("gap_ms"))
    upto = F.sum(F.col("dur_ms") + F.col("gap_ms")).over(Window.partitionBy("recording_id").orderBy("input_index"))
    rows = rows.withColumn("start_ms", upto - F.col("dur_ms") - F.col("gap_ms") + 1000).withColumn("end_ms", upto - F.col("gap_ms") + 1000)
    return rows.drop("gap_ms").withColumn("confidence", F.lit(None).cast("double"))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("case when (input_index*5+recording_id)%7=0 then 'unknown' when input_index%4=3 then 'local_spk_0' when speaker='user' then 'local_spk_1' else 'local_spk_2' end")
    return segments(spark, sf).withColumn("label", label)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("recording_id"), "event_id", ((n - 1) * 500).alias("start_ms"), (n * 500).alias("end_ms"), "event_type")
    active = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    dom = F.when(F.col("event_type").isin("click", "purchase"), "speaker_0").when(F.col("event_type") == "view", "speaker_1").when(F.col("event_type") == "signup", "speaker_2").otherwise("")
    return rows.withColumn("active", active).withColumn("dom", dom).drop("event_type")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return e.selectExpr(
        "event_id", "user_id recording_id", "500+(event_id*37)%5000 duration_ms", "(40+k*0.7D)/100 speech_ratio", "case when event_id%29=0 then 50 else 0 end overlap_ms",
        "case when event_id%31=0 then 1 else 0 end change_point_count", "case when event_id%43=0 then null else -60+value/8 end loudness_db", "(event_id%20)*1.0D loudness_std_db",
        "(event_id*13)%200 boundary_left_silence_ms", "(event_id*17)%200 boundary_right_silence_ms",
        "case when event_id%23=0 then array('tiny_interval','unstable_loudness') when event_id%19=0 then array('residual_overlap') when event_id%17=0 then array('low_speech_ratio') else cast(array() as array<string>) end flags",
        "(event_id%7)*1000 start_ms", "(event_id%7)*1000 + 500+(event_id*37)%5000 end_ms",
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Four sevenths of all vectors as gold windows; a recording holds five labels at most."""
    return table(spark, sf, "embeddings").filter("vec_id%7<4").selectExpr("vec_id%5+5*(label div 5) recording_id", "vec_id", "label", "cast(embedding as array<double>) embedding", "case when vec_id%3=0 then 0.7D else 1.0D end weight", "1000+(vec_id*37)%5000 start_ms", "1000+(vec_id*53)%4000 duration_ms", "case when vec_id%11=0 then null else -60.0D+vec_id%37 end loudness_db")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """All other vectors as sentences; some have no vector, some lie in recordings without anchors."""
    return table(spark, sf, "embeddings").filter("vec_id%7>=4").selectExpr("vec_id%5+5*(label div 5) + if(vec_id%41=0, 1000, 0) recording_id", "vec_id", "if(vec_id%23=0, null, cast(embedding as array<double>)) embedding", "1000+(vec_id*97)%7000 duration_ms", "0.4D+(vec_id%60)/100.0D speech_ratio", "(vec_id%20)*1.0D loudness_std_db", "-60.0D+vec_id%40 loudness_db")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("at", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return o.selectExpr(
        "lower(md5(cast(o_orderkey as string))) task_id", "o_orderkey",
        "case o_orderstatus when 'F' then case when o_orderkey%3=0 then 'failed' else 'succeeded' end when 'O' then case when o_orderkey%2=0 then 'queued' else 'running' end else case when o_orderkey%2=0 then 'cancelled' else 'expired' end end status",
        "at created_at_ms", "at + 60000 finished_at_ms", "at + 120000 expired_at_ms", "case when o_orderkey%13=0 then at + 30000 end cancel_requested_at_ms",
        "case when o_orderkey%5=0 then 'cloud_asr' else 'segments' end input_mode", "case when o_orderkey%4<>0 then concat('key-', cast(o_custkey as string)) end idempotency_key", "cast(o_orderkey%3 as string) input_digest",
    )


def oracle(*names: str) -> str:
    """A WITH clause of the views that are named, and those that they need."""
    needed = [n for n in SQL if n in names or (n == "v_seg" and "v_hyp" in names)]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in needed)
