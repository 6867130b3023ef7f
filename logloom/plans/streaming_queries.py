"""Streaming queries over the given tables, compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import streaming
from logloom.plans.queries import XML, query, xml_transactions
from logloom.plans.views import view

OK_CODES = frozenset({"OK", "SUCCESS", "PROCESSED_SUCCESSFULLY", "ACCEPTED", "COMPLETE", "COMPLETED"})


def _ms(c: str):
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


@query("select (epoch_us(time_bucket(interval '1 day', ts)) // 1000) as window_start, event_type as fingerprint, count(*) as n from events group by 1, 2")
def stream_rates(spark, sf_dir):
    e = streaming.read_table_stream(spark, sf_dir, "events").select(F.timestamp_millis(_ms("ts")).alias("ts"), F.col("event_type").alias("fingerprint"))
    done = streaming.run_once(streaming.rates(e, "1 day"), "complete")
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).select("window_start", "fingerprint", "n")


@query("select event_id as log_id from events")
def stream_ingest(spark, sf_dir):
    """Every line sent twice, kept once."""
    e = streaming.read_table_stream(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.timestamp_millis(_ms("ts")).alias("ts"))
    return streaming.run_once(streaming.ingest(e.withColumn("log_id", F.explode(F.array("log_id", "log_id"))))).select("log_id")


@query("select corr_id, case when final = 'error' and ts_response is not null then 'undecided' when final = 'error' then 'awaiting' else final end as status, ack_code, spawned_at from ruled", "v_tx3", "tx", "ruled")
def stream_transactions(spark, sf_dir):
    """The state after all events, before any timeout."""
    o = streaming.read_table_stream(spark, sf_dir, "orders")
    k, t = F.col("o_orderkey"), _ms("o_orderdate")
    event = lambda kind, prefix, at, code: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), k).alias("log_id"), at.alias("ts_ms"), code.alias("ack_code"))
    ack = t + (k % 60) * 60_000
    three = F.array(
        event("REQUEST", "m", t, F.lit(None).cast("string")), F.when(k % 11 != 0, event("ACK", "a", ack, F.when(k % 17 == 0, "FAILED").otherwise("OK"))),
        F.when(k % 13 != 0, event("RESPONSE", "r", ack + (F.col("o_custkey") % 50) * 60_000, F.lit("COMPLETED"))),
    )
    e = o.select(F.concat(F.lit("m"), k).alias("corr_id"), F.lit("xml").alias("application"), F.explode(F.filter(three, lambda x: x.isNotNull())).alias("e")).select("corr_id", "application", "e.*")
    out = streaming.run_once(streaming.transactions(e, XML, OK_CODES), "update", timers=True)
    return out.groupBy("corr_id").agg(F.max_by(F.struct("status", "ack_code", "spawned_at"), "batch").alias("s")).select("corr_id", "s.*")


@query("select concat('tx:', corr_id) as fingerprint, case when final = 'failed' then 'high' else 'medium' end as severity, corr_id from ruled where final in ('failed', 'error') and not exists (select 1 from v_anomalies a where a.fingerprint = concat('tx:', corr_id))", "v_tx3", "tx", "ruled", "v_anomalies")
def failure_reports(spark, sf_dir):
    return streaming.report_failures(xml_transactions(spark, sf_dir), view(spark, sf_dir, "v_anomalies"))
