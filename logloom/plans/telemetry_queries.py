"""Registered queries of the telemetry operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import logs, telemetry
from logloom.plans.queries import EXTRA, parsed, query, validated, xml_transactions
from logloom.plans.views import view

RUNS = "select event_id as id, user_id % 3 as trigger, (epoch_us(ts) // 1000) as started_at, case when event_id % 4 <> 0 then (epoch_us(ts) // 1000) + cast(floor(value * 10) as bigint) end as finished_at, event_id % 7 as produced from events"
LATEST = "(select max(epoch_us(ts) // 1000) from events)"
REVIEWS = "select event_id, concat('app', user_id % 3) as application, event_id % 3 = 0 as reviewed, case when event_id % 3 = 0 then event_id % 4 else 0 end as n_findings, case when event_id % 3 = 0 then event_id % 2 else 0 end as n_discarded, event_type = 'error' as failed, event_id % 11 = 0 as suppressed, case event_id % 5 when 0 then 'ai_suspected' when 1 then 'violation' else 'success' end as result from events"
RESULTS = ("success", "violation", "ai_suspected")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _runs(spark, sf_dir):
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    i = F.col("event_id")
    return _events(spark, sf_dir).select(i.alias("id"), (F.col("user_id") % 3).alias("trigger"), ms.alias("started_at"), F.when(i % 4 != 0, ms + F.floor(F.col("value") * 10)).alias("finished_at"), (i % 7).alias("produced"))


def _latest(runs):
    return runs.agg(F.max("started_at")).first()[0] or 0


def _reviews(spark, sf_dir):
    i = F.col("event_id")
    seen = i % 3 == 0
    return _events(spark, sf_dir).select(
        i, F.concat(F.lit("app"), F.col("user_id") % 3).alias("application"), seen.alias("reviewed"), F.when(seen, i % 4).otherwise(0).alias("n_findings"), F.when(seen, i % 2).otherwise(0).alias("n_discarded"),
        (F.col("event_type") == "error").alias("failed"), (i % 11 == 0).alias("suppressed"), F.when(i % 5 == 0, "ai_suspected").when(i % 5 == 1, "violation").otherwise("success").alias("result"),
    )


@query(
    "select coalesce(p.source, t.source) as source, coalesce(n_parsed, 0) as n_parsed, coalesce(n_anomalies, 0) as n_anomalies, coalesce(n_spawned, 0) as n_spawned, coalesce(n_closed, 0) as n_closed from (select source, count(*) as n_parsed, count(category) as n_anomalies from p_logs group by 1) p full join (select 'cloudwatch' as source, count(*) as n_spawned, count(case when final <> 'awaiting' then 1 end) as n_closed from ruled having count(*) > 0) t on p.source = t.source",
    "v_logs", "p_logs", "v_tx3", "tx", "ruled",
)
def poll_rollup(spark, sf_dir):
    lines = parsed(spark, sf_dir)
    t = xml_transactions(spark, sf_dir).select(F.lit("cloudwatch").alias("source"), F.lit(True).alias("spawned"), (~F.col("status").isin("awaiting", "undecided")).alias("closed"))
    return telemetry.poll_rollup(lines, logs.classified(lines).select("source"), t)


@query(f"select trigger, source, cast(sum(n) as bigint) as n, any_value(total) as total from (select trigger, unnest(['a', 'b']) as source, unnest([produced, produced * 2]) as n from ({RUNS}) r) x join (select trigger as g, cast(sum(produced * 3 + produced % 2) as bigint) as total from ({RUNS}) r group by 1) t on g = trigger group by 1, 2")
def run_totals(spark, sf_dir):
    r = _runs(spark, sf_dir)
    by = F.create_map(F.lit("a"), F.col("produced"), F.lit("b"), F.col("produced") * 2)
    return telemetry.run_totals(r.withColumn("by_source", by).withColumn("lifecycle", F.col("produced") % 2), "trigger")


@query(f"select id, started_at from ({RUNS}) r where finished_at is null and started_at >= (select max(started_at) from ({RUNS}) s where finished_at is null) - 600000")
def open_runs(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return telemetry.open_runs(r, _latest(r.where("finished_at is null"))).select("id", "started_at")


@query(f"select * from (select id, 'finished' as kind, finished_at as at from ({RUNS}) r where finished_at is not null order by finished_at desc, id limit 20) a union all select * from (select id, 'open' as kind, started_at as at from ({RUNS}) r where finished_at is null order by started_at desc, id limit 20) b")
def newest_runs(spark, sf_dir):
    r = _runs(spark, sf_dir)
    done = telemetry.newest_runs(r, 20, True).select("id", F.lit("finished").alias("kind"), F.col("finished_at").alias("at"))
    return done.unionByName(telemetry.newest_runs(r, 20, False).select("id", F.lit("open").alias("kind"), F.col("started_at").alias("at")))


@query(f"select count(*) as runs, count(*) filter (where started_at >= {LATEST} - 86400000) as recent, max(started_at) as last_ms, round(avg(finished_at - started_at), 4) as mean_ms, quantile_cont(finished_at - started_at, 0.95) as p95_ms, cast(sum(produced) as bigint) as produced from ({RUNS}) r")
def poller_stats(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return telemetry.poller_stats(r, _latest(r)).withColumn("mean_ms", F.round("mean_ms", 4))


@query(f"select count(*) filter (where reviewed) as reviewed, count(*) filter (where result = 'ai_suspected') as suspected, cast(sum(n_discarded) as bigint) as discarded, count(*) filter (where failed) as failed, cast(sum(n_findings) as bigint) as admitted, round(sum(n_discarded) / nullif(sum(n_findings) + sum(n_discarded), 0)::double, 6) as discard_rate from ({REVIEWS}) v")
def review_scorecard(spark, sf_dir):
    return telemetry.review_scorecard(_reviews(spark, sf_dir)).withColumn("discard_rate", F.round("discard_rate", 6))


@query("select application, count(*) as n, " + ", ".join(f"count(*) filter (where result = '{r}') as n_{r}" for r in RESULTS) + f", count(*) filter (where reviewed) as reviewed, cast(sum(n_discarded) as bigint) as rejected, count(*) filter (where failed) as failed, count(*) filter (where suppressed) as suppressed from ({REVIEWS}) v group by rollup(application)")
def review_scorecard_by_application(spark, sf_dir):
    return telemetry.validation_scorecard(_reviews(spark, sf_dir), RESULTS)


@query("select concat('rule', k) as rule, count(*) as n from (select unnest([event_id % 13, user_id % 17]) as k from events) x group by 1 order by n desc, rule limit 10")
def rule_tally(spark, sf_dir):
    e = _events(spark, sf_dir)
    return telemetry.rule_tally(e.select(F.transform(F.array(F.col("event_id") % 13, F.col("user_id") % 17), lambda k: F.concat(F.lit("rule"), k)).alias("proposed_rules")))


@query("select concat('alert-', anomaly_id) as alert_id, anomaly_id, 'dashboard' as channel, 'pending' as status from v_anomalies where severity in ('high', 'critical')", "v_anomalies")
def new_alerts(spark, sf_dir):
    return telemetry.alerts(view(spark, sf_dir, "v_anomalies"))


#: Orders as transactions of which some still wait.
WAITING = "select concat('m', o_orderkey) as corr_id, 'xml' as application, case o_orderstatus when 'O' then 'awaiting' when 'P' then 'undecided' else 'completed' end as status, (epoch_us(o_orderdate::timestamp) // 1000) as spawned_at, o_orderkey from orders"


def _waiting(spark, sf_dir):
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz"))
    status = F.when(F.col("o_orderstatus") == "O", "awaiting").when(F.col("o_orderstatus") == "P", "undecided").otherwise("completed")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m"), "o_orderkey").alias("corr_id"), F.lit("xml").alias("application"), status.alias("status"), ms.alias("spawned_at"), "o_orderkey")


@query(f"select corr_id, status, spawned_at from ({WAITING}) t where status in ('awaiting', 'undecided') order by spawned_at, corr_id limit 50")
def active_by_spawn(spark, sf_dir):
    return telemetry.active_by_spawn(_waiting(spark, sf_dir), 50).select("corr_id", "status", "spawned_at")


@query(f"select corr_id, status from ({WAITING}) t where status in ('awaiting', 'undecided') or o_orderkey % 5 = 0")
def active_and_matching(spark, sf_dir):
    t = _waiting(spark, sf_dir)
    return telemetry.active_and_matching(t, t.where("o_orderkey % 5 = 0")).select("corr_id", "status")


@query("select distinct stream, doc_id as entry from v_lines where (doc_id + line_no) % 10 = 0", "v_lines")
def fresh_entries(spark, sf_dir):
    """Documents stand for entries; lines whose numbers add up to a multiple of ten are new."""
    lines = view(spark, sf_dir, "v_lines").withColumn("log_id", F.concat_ws(":", "doc_id", "line_no"))
    entries = lines.groupBy("stream", F.col("doc_id").alias("entry")).agg(F.collect_list("log_id").alias("log_ids"))
    return telemetry.fresh_entries(entries, lines.where((F.col("doc_id") + F.col("line_no")) % 10 == 0)).select("stream", "entry")


@query("select log_id, t as type, log_id as message_id, concat('m', substr(log_id, 2)) as corr_id, nullif(regexp_extract(raw, '<ackCode>([A-Z]+)</ackCode>', 1), '') as ack_code from v_tx3", "v_tx3")
def message_view(spark, sf_dir):
    return telemetry.message_view(view(spark, sf_dir, "v_tx3").drop("t")).drop("application")


EXTRA["cases"] = """
select *, case when found and wanted then 'tp' when found then 'fp' when wanted then 'fn' else 'tn' end as verdict, case when known_gap then case when found = wanted then 'resolved' else 'open' end end as gap
from (select o_orderkey as case_id, corr_id, expected, result, coalesce(result <> 'success', false) as found, expected <> 'success' as wanted, known_gap
  from (select o_orderkey, concat('m', o_orderkey) as corr_id, case when o_orderkey % 17 = 0 and o_orderkey % 11 <> 0 then 'violation' else 'success' end as expected, o_orderkey % 37 = 0 as known_gap from orders where o_orderkey % 3 = 0) c
  left join (select corr_id as r, result from val) v on c.corr_id = v.r) x"""


def _cases(spark, sf_dir):
    """Gold cases derived from orders, replayed through assembly and validation."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(k % 3 == 0)
    cases = orders.select(k.alias("case_id"), F.concat(F.lit("m"), k).alias("corr_id"), F.when((k % 17 == 0) & (k % 11 != 0), "violation").otherwise("success").alias("expected"), (k % 37 == 0).alias("known_gap"))
    return telemetry.classify_cases(cases, validated(spark, sf_dir))


@query("select case_id, corr_id, expected, result, verdict, gap from cases", "v_tx3", "tx", "ruled", "sev", "val", "cases")
def gold_replay(spark, sf_dir):
    return _cases(spark, sf_dir)


_N = {v: f"count(*) filter (where gap is null and verdict = '{v}')" for v in ("tp", "fp", "fn")}


@query(
    f"select precision, recall, gaps_open, gaps_resolved, precision >= 1.0 and recall >= 1.0 as passed from (select case when {_N['tp']} + {_N['fp']} > 0 then {_N['tp']} / ({_N['tp']} + {_N['fp']})::double else 1.0 end as precision, case when {_N['tp']} + {_N['fn']} > 0 then {_N['tp']} / ({_N['tp']} + {_N['fn']})::double else 1.0 end as recall, count(*) filter (where gap = 'open') as gaps_open, count(*) filter (where gap = 'resolved') as gaps_resolved from cases) g",
    "v_tx3", "tx", "ruled", "sev", "val", "cases",
)
def gold_gate(spark, sf_dir):
    return telemetry.gate(_cases(spark, sf_dir))
