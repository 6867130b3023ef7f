"""Registered queries of the log-analytics operators, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import parsing, protocols
from logloom.functions import patterns as P
from logloom.operators import claims, identity, lifecycle, logs, similarity, tables, transactions, validation
from logloom.operators.shared import spread
from logloom.plans.views import duckdb_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_010_000_000_000
XML = protocols.XML_APP


def query(sql: str | None = None, *views: str):
    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes = [f"{v} as ({EXTRA[v] if v in EXTRA else duckdb_sql(v)})" for v in views]
            ORACLE_SQL[f.__name__] = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return register


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _template(x: str) -> str:
    for p, m in P.MASKS:
        x = f"regexp_replace({x}, {_q(p)}, '{m}', 'g')"
    return f"trim({x})"


_EXPLICIT = "case when raw like '{%' then json_extract_string(raw, '$.level') when raw like 'level=%' then regexp_extract(raw, '^level=(\\w+)', 1) end"
_LEVEL = "case " + " ".join(f"when regexp_matches(raw, {_q(p)}) then '{n}'" for n, p in P.LEVEL_WORDS) + " else 'unknown' end"
_CATEGORY = (
    "case when coalesce(status_code, 0) between 500 and 599 then 'http_5xx' when status_code in (401, 403) then 'auth' when status_code = 429 then 'rate_limit' "
    "when status_code between 400 and 499 then 'http_4xx' when coalesce(latency_ms, 0) >= 3000 then 'latency' "
    + " ".join(f"when regexp_matches(message, {_q(p)}) then '{n}'" for n, p in P.CATEGORIES)
    + " when level in ('error', 'fatal') then 'exception' end"
)
_XML_TX = """
select corr_id, 'xml' as application, min(case when t = 'REQUEST' then ts_ms end) as ts_request, min(case when t = 'ACK' then ts_ms end) as ts_ack, min(case when t = 'RESPONSE' then ts_ms end) as ts_response,
  min(ts_ms) as spawned_at, greatest(max(case when t = 'REQUEST' then ts_ms end), max(ts_ms)) as any_last, count(case when t = 'ACK' and code = 'FAILED' then 1 end) as n_failing,
  arg_max(code, (ts_ms, log_id)) filter (where code <> '') as ack_code
from (select concat('m', substr(log_id, 2)) as corr_id, t, ts_ms, log_id, regexp_extract(raw, '<ackCode>([A-Z]+)</ackCode>', 1) as code from v_tx3) e group by corr_id"""
_XML_RULED = f"""
select *, case when status = 'awaiting0' then 'error' else status end as final from (
  select *, greatest(coalesce(ts_request, 0), coalesce(ts_ack, 0), coalesce(ts_response, 0), spawned_at) as last_activity,
    case when ack_code = 'FAILED' then 'failed' when ts_request is not null and ts_ack is not null and ts_response is not null then 'completed' else 'awaiting0' end as status
  from tx) y"""
#: Views that build on others; `now` lies after all orders, so nothing is still waiting.
EXTRA = {
    "p_logs": f"""
select *, {_CATEGORY} as category from (
  select *, {_template('message')} as template, substr(sha1({_template('message')}), 1, 16) as fingerprint, coalesce({_EXPLICIT}, {_LEVEL}) as level from (
    select *, case when raw like '{{%' then json_extract_string(raw, '$.message') when raw like 'level=%' then regexp_extract(raw, 'msg="([^"]*)"', 1) else raw end as message,
      try_cast(nullif(regexp_extract(raw, {_q(P.STATUS)}, 1), '') as integer) as status_code, try_cast(nullif(regexp_extract(raw, {_q(P.LATENCY)}, 1), '') as double) as latency_ms
    from v_logs) a) b""",
    "tx": _XML_TX,
    "ruled": _XML_RULED,
    "sev": "select concat('m', o_orderkey) as corr_id, case when o_orderkey % 23 = 0 then 'low' when o_orderkey % 17 = 0 then 'high' else 'medium' end as actual_severity from orders where o_orderkey % 19 <> 0 and (o_orderkey % 17 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0)",
}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(spread(view(spark, sf_dir, "v_logs")))


def xml_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.assemble(protocols.events(spread(view(spark, sf_dir, "v_tx3").drop("t")), (XML,)), XML, NOW)


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.when(k % 23 == 0, "low").when(k % 17 == 0, "high").otherwise("medium")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.where((k % 19 != 0) & ((k % 17 == 0) | (k % 11 == 0) | (k % 13 == 0))).select(F.concat(F.lit("m"), k).alias("corr_id"), level.alias("actual_severity"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = validation.derive_outcome(xml_transactions(spark, sf_dir), XML).join(severities(spark, sf_dir), "corr_id", "left")
    number = F.substring("corr_id", 2, 20).cast("long")
    return validation.validate(t.withColumn("quality", F.when(number % 29 == 0, F.array(F.lit("low"), F.lit("critical"))).when(number % 31 == 0, F.array(F.lit("low")))), XML, NOW)


# ---- parsing ---------------------------------------------------------------------------------------------------


@query("select log_id, level, message, status_code, latency_ms, template, fingerprint from p_logs", "v_logs", "p_logs")
def parse_logs(spark, sf_dir):
    return parsed(spark, sf_dir).select("log_id", "level", "message", "status_code", "latency_ms", "template", "fingerprint")


@query(
    "select kind, val as value, count(*) as n from (select 'requestId' as kind, unnest(list_distinct(regexp_extract_all(raw, " + _q(P.ENTITIES["requestId"][0]) + ", 1))) as val from v_logs union all select 'ip', unnest(list_distinct(regexp_extract_all(raw, " + _q(P.ENTITIES["ip"][0]) + "))) from v_logs union all select 'host', unnest(list_distinct(regexp_extract_all(raw, "
    + _q(P.ENTITIES["host"][0]) + ", 1))) from v_logs union all select 'service', unnest(list_distinct(regexp_extract_all(raw, " + _q(P.ENTITIES["service"][0]) + ", 1))) from v_logs union all select 'statusCode', unnest(list_distinct(regexp_extract_all(raw, " + _q(P.ENTITIES["statusCode"][0]) + ", 1))) from v_logs) x group by 1, 2",
    "v_logs",
)
def entity_values(spark, sf_dir):
    e = view(spark, sf_dir, "v_logs").select(F.explode(parsing.entities(F.col("raw")))).select(F.col("key").alias("kind"), F.explode("value").alias("value"))
    return e.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("select log_id, case when raw like '{%' then json_extract_string(raw, '$.service') when raw like 'level=%' then regexp_extract(raw, 'service=(\\S+)', 1) end as service, cast(status_code as varchar) as status_text from p_logs", "v_logs", "p_logs")
def field_precedence(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return p.select("log_id", F.col("fields")["service"].alias("service"), F.col("fields")["statusCode"].alias("status_text"))


@query("select category, level, count(*) as n, min(ts_ms) as first_ms, max(ts_ms) as last_ms from p_logs group by 1, 2", "v_logs", "p_logs")
def classify_logs(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy(parsing.category().alias("category"), "level").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f"select doc_id, line_no, substr(sha1({_template('raw')}), 1, 16) as fingerprint from v_lines", "v_lines")
def line_fingerprints(spark, sf_dir):
    return view(spark, sf_dir, "v_lines").select("doc_id", "line_no", parsing.fingerprint(F.col("raw")).alias("fingerprint"))


# ---- clusters and baselines --------------------------------------------------------------------------------------


@query(
    "select concat(category, ':', fingerprint) as key, category, fingerprint, count(*) as n_logs, cast(count(distinct source) as integer) as n_sources, min(ts_ms) as window_start, max(ts_ms) as window_end from p_logs where category is not null group by category, fingerprint",
    "v_logs", "p_logs",
)
def category_clusters(spark, sf_dir):
    return logs.category_clusters(parsed(spark, sf_dir)).drop("sources")


@query(
    "select key, n_logs, n_sources from (select concat(category, ':', fingerprint) as key, count(*) as n_logs, cast(count(distinct source) as integer) as n_sources from p_logs where category is not null group by category, fingerprint) x where n_sources >= 2 order by n_sources desc, n_logs desc, key limit 200",
    "v_logs", "p_logs",
)
def top_clusters(spark, sf_dir):
    """Cross-source clusters, most sources first: the units of one run."""
    c = logs.category_clusters(parsed(spark, sf_dir)).where("n_sources >= 2")
    return c.orderBy(F.desc("n_sources"), F.desc("n_logs"), "key").limit(200).select("key", "n_logs", "n_sources")


@query(
    "select category, fingerprint, string_agg(log_id, ',' order by ts_ms, log_id) as evidence, min(ts_ms) as first_ms from (select *, row_number() over (partition by category, fingerprint order by ts_ms, log_id) as r from p_logs where category is not null) x where r <= 10 group by category, fingerprint",
    "v_logs", "p_logs",
)
def cluster_evidence(spark, sf_dir):
    e = logs.with_evidence(parsed(spark, sf_dir))
    return e.select("category", "fingerprint", F.array_join("evidence.log_id", ",").alias("evidence"), F.element_at("evidence", 1)["ts_ms"].alias("first_ms"))


@query(
    "select concat(category, ':', fingerprint) as key, count(*) as n_logs from p_logs where category is not null group by category, fingerprint",
    "v_logs", "p_logs",
)
def clusters_beside_transactions(spark, sf_dir):
    """Lines of transactions among the others, their failures included, make no clusters."""
    both = view(spark, sf_dir, "v_logs").select("log_id", "source", "stream", "ts_ms", "raw").unionByName(view(spark, sf_dir, "v_tx3").select("log_id", "source", "stream", "ts_ms", "raw"))
    return logs.category_clusters(parsing.parse(logs.unclaimed(spread(both))), claimed=False).select("key", "n_logs")


_KEYS = " union all ".join(f"select log_id, source, ts_ms, concat('{k}:', unnest(list_distinct(regexp_extract_all(raw, {_q(P.ENTITIES[k][0])}, {P.ENTITIES[k][1]})))) as key from v_logs" for k in P.CORRELATION_ENTITIES)


@query(f"select key, count(*) as n_logs, min(ts_ms) as window_start, max(ts_ms) as window_end, count(distinct source) as n_sources from ({_KEYS}) x group by key having count(*) >= 2 and (max(ts_ms) - min(ts_ms) <= 300000 or count(distinct source) >= 2)", "v_logs")
def correlate_entities(spark, sf_dir):
    return logs.correlate(parsed(spark, sf_dir))


@query("select fingerprint, cast(floor(ts_ms / 86400000.0) as bigint) * 86400000 as window_start, count(*) as n, count(*) / 1440.0::double as rate from p_logs group by 1, 2", "v_logs", "p_logs")
def windowed_rates(spark, sf_dir):
    return logs.rates(parsed(spark, sf_dir), 86_400_000).drop("sample")


@query(
    """, recursive_in as (select fingerprint, n, n / 1440.0::double as rate, row_number() over (partition by fingerprint order by w) as k from (select fingerprint, cast(floor(ts_ms / 86400000.0) as bigint) as w, count(*) as n from p_logs group by 1, 2) a),
folded as (
  select fingerprint, k, n, rate as x, rate as r, 0.0::double as v, 0.0::double as z, 0.0::double as p from recursive_in where k = 1
  union all
  select i.fingerprint, i.k, i.n, i.rate, 0.3 * i.rate + (1 - 0.3) * f.r, (1 - 0.3) * (f.v + 0.3 * ((i.rate - f.r) * (i.rate - f.r))),
    (i.rate - f.r) / (case when f.v > 0 then sqrt(f.v) else i.rate * 0.25 + 1 end), f.r from folded f join recursive_in i on i.fingerprint = f.fingerprint and i.k = f.k + 1)
select f.fingerprint, cast(t.occurrences as bigint) as occurrences, round(r, 6) as ewma_rate, round(v, 6) as ewma_variance, round(z, 4) as z_score, f.k = 1 as is_new, (f.k = 1 and n >= 3) or z >= 3 as anomalous
from folded f join (select fingerprint, max(k) as k, sum(n) as occurrences from recursive_in group by 1) t on t.fingerprint = f.fingerprint and t.k = f.k""",
    "v_logs", "p_logs",
)
def baseline_scores(spark, sf_dir):
    b = logs.baselines(logs.rates(parsed(spark, sf_dir), 86_400_000))
    return b.select("fingerprint", "occurrences", F.round("ewma_rate", 6).alias("ewma_rate"), F.round("ewma_variance", 6).alias("ewma_variance"), F.round("z_score", 4).alias("z_score"), "is_new", "anomalous")


ORACLE_SQL["baseline_scores"] = ORACLE_SQL["baseline_scores"].replace("with ", "with recursive ", 1).replace("\n, recursive_in", ",\nrecursive_in", 1)


@query(
    "select stream, cast(entry as bigint) as entry, min(doc_id) as doc_id, count(*) as n_lines, md5(string_agg(rtrim(raw), chr(10) order by doc_id, line_no)) as text_hash from (select *, sum(case when regexp_matches(raw, " + _q(P.STARTS_ENTRY) + ") or rn = 1 then 1 else 0 end) over (partition by stream order by doc_id, line_no) as entry from (select *, row_number() over (partition by stream order by doc_id, line_no) as rn from v_lines) a) b group by stream, entry",
    "v_lines",
)
def coalesced_entries(spark, sf_dir):
    e = logs.entries(view(spark, sf_dir, "v_lines"), ["doc_id", "line_no"])
    return e.select("stream", "entry", "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.md5("raw").alias("text_hash"))


# ---- transactions ------------------------------------------------------------------------------------------------


@query("select log_id, t as type, concat('m', substr(log_id, 2)) as corr_id, nullif(regexp_extract(raw, '<ackCode>([A-Z]+)</ackCode>', 1), '') as ack_code, 'xml' as application from v_tx3", "v_tx3")
def transaction_events(spark, sf_dir):
    return protocols.events(view(spark, sf_dir, "v_tx3").drop("t")).select("log_id", "type", "corr_id", "ack_code", "application")


@query(
    "select corr_id, final as status, ts_request, ts_ack, ts_response, spawned_at, ack_code, case when final = 'error' then last_activity + 1800000 else last_activity end as closed_at from ruled", "v_tx3", "tx", "ruled"
)
def transactions_xml(spark, sf_dir):
    t = xml_transactions(spark, sf_dir)
    return t.select("corr_id", "status", F.col("ts_REQUEST").alias("ts_request"), F.col("ts_ACK").alias("ts_ack"), F.col("ts_RESPONSE").alias("ts_response"), "spawned_at", "ack_code", "closed_at")


@query("select 'xml' as application, final as status, count(*) as n, quantile_cont(last_activity - spawned_at, 0.5) as p50, quantile_cont(last_activity - spawned_at, 0.95) as p95, max(last_activity - spawned_at) as longest from ruled group by final", "v_tx3", "tx", "ruled")
def transaction_lifetimes(spark, sf_dir):
    life = F.col("last_activity") - F.col("spawned_at")
    p = F.percentile(life, F.array(F.lit(0.5), F.lit(0.95)))
    return xml_transactions(spark, sf_dir).groupBy("application", "status").agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.max(life).alias("longest")).select("application", "status", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "longest")


@query("select count(*) as spawned, count(case when final <> 'awaiting' then 1 end) as closed, count(case when (case when ts_request is null then 1 else 0 end + case when ts_ack is null then 1 else 0 end + case when ts_response is null then 1 else 0 end) < 2 then 1 end) as advanced, 'xml' as application from ruled", "v_tx3", "tx", "ruled")
def transaction_counts(spark, sf_dir):
    return transactions.counts_by_app(xml_transactions(spark, sf_dir))


@query("select corr_id, spawned_at, turn from (select corr_id, spawned_at, row_number() over (order by last_activity + 1800000, corr_id) as turn from ruled where final = 'error') x where turn <= 50", "v_tx3", "tx", "ruled")
def fair_share_selection(spark, sf_dir):
    t = xml_transactions(spark, sf_dir).where("status = 'error'").withColumn("deadline", F.col("last_activity") + 1_800_000)
    chosen, _ = lifecycle.hand_off(t.select("application", "corr_id", "spawned_at", "deadline"), 50)
    return chosen.select("corr_id", "spawned_at", "turn")


@query("select corr_id, log_id, place from (select concat('m', substr(log_id, 2)) as corr_id, log_id, row_number() over (partition by substr(log_id, 2) order by case when raw like '%FAILED%' then 0 else 1 end, ts_ms, log_id) as place from v_tx3) x where place <= 2", "v_tx3")
def evidence_ranking(spark, sf_dir):
    e = protocols.events(view(spark, sf_dir, "v_tx3").drop("t"))
    return transactions.evidence_lines(e, F.contains("raw", F.lit("FAILED")), limit=2).select("corr_id", "log_id", "place")


@query("select concat('corr:c', o_orderkey) as call, case when o_orderkey % 9 = 0 then null when o_orderkey % 10 = 0 then 500 else 200 end as http_status, case when o_orderkey % 9 = 0 then 'awaiting' when o_orderkey % 10 = 0 then 'failed' else 'completed' end as outcome from orders")
def call_outcomes(spark, sf_dir):
    v = spread(view(spark, sf_dir, "v_calls"))
    return identity.outcomes(v, identity.call_map(v)).select("call", "http_status", "outcome")


@query("select concat('corr:c', o_orderkey) as call, case when o_orderkey % 9 = 0 then null when o_orderkey % 10 = 0 then 500 else 200 end as http_status, case when o_orderkey % 9 = 0 then 'awaiting' when o_orderkey % 10 = 0 then 'failed' else 'completed' end as outcome from orders")
def call_outcomes_over_entries(spark, sf_dir):
    """The gateway writes its trace id on a line of its own: only the joined entry ties it to the call."""
    v = view(spark, sf_dir, "v_calls")
    lines = v.select("stream", "ts_ms", "o_orderkey", "log_id", F.posexplode(F.split("raw", " (?=x-amzn)")).alias("line_no", "raw"))
    e = logs.entries(lines, ["ts_ms", "o_orderkey", "log_id", "line_no"]).select("log_id", "ts_ms", "raw")
    return identity.outcomes(e, identity.call_map(e)).select("call", "http_status", "outcome")


@query("select log_id, cast(2 as bigint) as n_lines, md5(replace(raw, '<messageType>', concat(chr(10), '<messageType>'))) as text_hash from v_tx3", "v_tx3")
def protocol_entries(spark, sf_dir):
    """Messages over two lines, of which the protocol tells where one begins."""
    lines = view(spark, sf_dir, "v_tx3").select("stream", "ts_ms", "log_id", F.posexplode(F.split("raw", "(?=<messageType>)")).alias("line_no", "raw"))
    e = logs.entries(lines, ["ts_ms", "log_id", "line_no"], starts=F.col("raw").rlike(XML.starts_entry))
    return e.select("log_id", F.col("n_lines").cast("long").alias("n_lines"), F.md5("raw").alias("text_hash"))


@query("select concat('c', o_orderkey) as corr_id, 'calls' as application, 'REQUEST' as type from orders")
def call_events(spark, sf_dir):
    return protocols.events(view(spark, sf_dir, "v_calls")).select("corr_id", "application", "type")


# ---- joins -------------------------------------------------------------------------------------------------------


@query("select corr_id from ruled where final in ('failed', 'error') and not exists (select 1 from v_anomalies a where a.fingerprint = concat('tx:', corr_id))", "v_tx3", "tx", "ruled", "v_anomalies")
def unreported_closures(spark, sf_dir):
    t = xml_transactions(spark, sf_dir).where(F.col("status").isin("failed", "error"))
    return t.join(view(spark, sf_dir, "v_anomalies"), F.concat(F.lit("tx:"), "corr_id") == F.col("fingerprint"), "left_anti").select("corr_id")


@query("select corr_id, final as status from ruled where corr_id in (select substr(fingerprint, 4) from v_anomalies where fingerprint like 'tx:%')", "v_tx3", "tx", "ruled", "v_anomalies")
def reported_transactions(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies").where(F.col("fingerprint").startswith("tx:")).select(F.substring("fingerprint", 4, 40).alias("corr_id"))
    return xml_transactions(spark, sf_dir).join(a, "corr_id", "left_semi").select("corr_id", "status")


@query("select r.corr_id, a.severity from ruled r left join (select fingerprint, arg_max(severity, (created_at, anomaly_id)) as severity from v_anomalies where fingerprint like 'tx:%' group by 1) a on a.fingerprint = concat('tx:', r.corr_id)", "v_tx3", "tx", "ruled", "v_anomalies")
def actual_levels(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies").where(F.col("fingerprint").startswith("tx:")).groupBy("fingerprint").agg(F.max_by("severity", F.struct("created_at", "anomaly_id")).alias("severity"))
    return xml_transactions(spark, sf_dir).join(a, F.concat(F.lit("tx:"), "corr_id") == F.col("fingerprint"), "left").select("corr_id", "severity")


_LATE = "(select max(created_at) from v_anomalies)"


@query(f"select fingerprint, arg_min(anomaly_id, (created_at, anomaly_id)) as anomaly_id from v_anomalies where created_at > {_LATE} - 86400000 and fingerprint not in (select fingerprint from v_anomalies where created_at between {_LATE} - 2 * 86400000 and {_LATE} - 86400000) group by 1", "v_anomalies")
def undeduplicated_findings(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies")
    end = a.agg(F.max("created_at")).first()[0] or 0
    cut = end - 86_400_000
    recent, stored = a.where(F.col("created_at") > cut), a.where(F.col("created_at").between(cut - 86_400_000, cut))
    return recent.join(stored, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min_by("anomaly_id", F.struct("created_at", "anomaly_id")).alias("anomaly_id"))


@query(
    "select r.corr_id, case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'failed' else 'unknown' end as recorded, (o_orderstatus = 'F' and final in ('failed', 'error')) or (o_orderstatus = 'P' and final = 'completed') as mismatch from ruled r join orders o on r.corr_id = concat('m', o_orderkey)",
    "v_tx3", "tx", "ruled",
)
def reconcile_outcomes(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "Settled").when(F.col("o_orderstatus") == "P", "Rejected by bank").otherwise("in process")
    record = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m"), "o_orderkey").alias("corr_id"), validation.record_outcome(F.lit(None).cast("boolean"), word).alias("recorded"))
    t = xml_transactions(spark, sf_dir).join(record, "corr_id")
    bad = ((F.col("recorded") == "completed") & F.col("status").isin("failed", "error")) | ((F.col("recorded") == "failed") & (F.col("status") == "completed"))
    return t.select("corr_id", "recorded", bad.alias("mismatch"))


@query("select concat('corr:c', o_orderkey) as call from orders where o_orderkey % 9 <> 0 and o_orderkey % 3 = 1")
def pending_signals(spark, sf_dir):
    """Active calls whose joined entries now carry an HTTP status."""
    v = view(spark, sf_dir, "v_calls")
    active = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 1").select(F.concat(F.lit("corr:c"), "o_orderkey").alias("call"))
    proven = identity.outcomes(v, identity.call_map(v)).where("http_status is not null")
    return active.join(proven, "call", "left_semi")


# ---- validation --------------------------------------------------------------------------------------------------

_VALID = """
select *, case when n_delta > 0 then 'failure' when final = 'completed' and k % 29 = 0 then 'completed_with_issues' else 'success' end as result from (
  select *, (case when final = 'failed' and sev is null or final = 'error' and sev is null or final = 'completed' and sev is not null or final = 'failed' and sev <> 'high' or final = 'error' and sev <> 'medium' then 1 else 0 end)
    + (case when final = 'completed' and breached then 1 else 0 end) + (case when n_failing > 0 and final = 'completed' or n_failing = 0 and ts_response is not null and final in ('failed', 'error') then 1 else 0 end) as n_delta
  from (select r.*, cast(substr(r.corr_id, 2) as bigint) as k, s.actual_severity as sev, ts_response - ts_ack as latency, coalesce(ts_response - ts_ack > 1800000, false) as breached from ruled r left join sev s on s.corr_id = r.corr_id) a) b"""
EXTRA["val"] = _VALID


@query("select corr_id, final as status, result, cast(n_delta as integer) as n_delta, breached as sla_breached, latency as response_latency_ms from val", "v_tx3", "tx", "ruled", "sev", "val")
def validate_transactions(spark, sf_dir):
    return validated(spark, sf_dir).select("corr_id", "status", "result", F.size("delta").alias("n_delta"), "sla_breached", "response_latency_ms")


@query(
    "select application, count(*) as total, count(case when result = 'success' then 1 end) as success, count(case when result = 'failure' then 1 end) as failure, count(case when result = 'completed_with_issues' then 1 end) as completed_with_issues, count(case when breached then 1 end) as sla_breached, count(case when n_delta > 0 then 1 end) as with_delta, round(avg(case when ts_ack is not null and ts_response is not null then latency end), 4) as mean_latency_ms from val group by rollup(application)",
    "v_tx3", "tx", "ruled", "sev", "val",
)
def validation_scorecard(spark, sf_dir):
    return validation.scorecard(validated(spark, sf_dir)).drop("pending", "ai_suspected")


_RAW = "select concat('o', o_orderkey) as corr_id, (epoch_us(o_orderdate) // 1000) as r, lo as a, hi as p from orders join (select l_orderkey, (epoch_us(min(l_shipdate)) // 1000) as lo, (epoch_us(max(l_shipdate)) // 1000) as hi from lineitem group by 1) l on l_orderkey = o_orderkey"


def _shipped(spark, sf_dir) -> DataFrame:
    ms = lambda c: F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.min(ms("l_shipdate")).alias("ts_ACK"), F.max(ms("l_shipdate")).alias("ts_RESPONSE"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("corr_id"), ms("o_orderdate").alias("ts_REQUEST"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"select corr_id, 'REQUEST' as earlier, 'ACK' as later from ({_RAW}) x where a < r union all select corr_id, 'ACK', 'RESPONSE' from ({_RAW}) y where p < a")
def phase_order(spark, sf_dir):
    return validation.order_violations(_shipped(spark, sf_dir), XML)


@query("select concat('o', l_orderkey) as corr_id, 'ACK' as type, count(distinct l_suppkey) as n from lineitem group by 1 having count(distinct l_suppkey) > 1")
def duplicate_followups(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("corr_id"), F.lit("ACK").alias("type"), F.col("l_suppkey").cast("string").alias("own_id"))
    return validation.duplicate_followups(li, XML)


_RATES = "case when tp + fp = 0 then 1.0 else tp / (tp + fp)::double end as precision, case when tp + fn = 0 then 1.0 else tp / (tp + fn)::double end as recall"
_COUNTS = "count(case when quality = 0 and toxic = 1 then 1 end) as tp, count(case when quality <> 0 and toxic <> 1 then 1 end) as tn, count(case when quality <> 0 and toxic = 1 then 1 end) as fp, count(case when quality = 0 and toxic <> 1 then 1 end) as fn"


@query(
    f"select \"by\", value, tp, tn, fp, fn, precision, recall, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1, case when tp + tn + fp + fn = 0 then 1.0 else (tp + tn) / (tp + tn + fp + fn)::double end as accuracy from (select *, {_RATES} from (select 'all' as \"by\", 'all' as value, {_COUNTS} from labels union all select 'mode', cast(doc_id % 3 as varchar), {_COUNTS} from labels group by 2) a) b"
)
def label_metrics(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 0).alias("expected"), (F.col("toxic") == 1).alias("flagged"), (F.col("doc_id") % 3).alias("mode"))
    return validation.metrics(c, "mode")


@query(f"select fp = 0 and fn = 0 as passed from (select {_COUNTS} from labels) x")
def label_gate(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 0).alias("expected"), (F.col("toxic") == 1).alias("flagged"))
    return validation.gate(validation.metrics(c))


@query("select count(*) as closed, count(case when n_delta > 0 then 1 end) as with_delta, count(case when result = 'success' and final = 'completed' then 1 end) as clean from val", "v_tx3", "tx", "ruled", "sev", "val")
def review_eligibility(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.agg(F.count_if(~F.col("active")).alias("closed"), F.count_if(F.size("delta") > 0).alias("with_delta"), F.count_if((F.col("result") == "success") & (F.col("status") == "completed")).alias("clean"))


def _claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 11 <> 0")
    k = F.col("o_orderkey")
    p = lambda log, op, value: F.struct(log.alias("log_id"), F.lit("raw").alias("field"), F.lit(op).alias("op"), value.alias("value"))
    ack, ghost = F.concat(F.lit("a"), k), F.concat(F.lit("zz"), k)
    kind = k % 6
    preds = (
        F.when(kind == 0, F.array(p(ack, "contains", F.lit("<ackCode>OK")))).when(kind == 1, F.array(p(ghost, "contains", F.lit("OK")))).when(kind == 2, F.array(p(ack, "not_contains", F.lit("OK"))))
        .when(kind == 3, F.array(p(ack, "contains", F.concat(F.lit("m"), k)))).when(kind == 4, F.array(p(ack, "matches", F.lit("ack[CD]ode>(ok|failed)")), p(ack, "contains", F.lit("ACK")))).otherwise(F.array(p(ack, "contains", F.lit("ACK")), p(ack, "contains", F.lit("ack"))))
    )
    evidence = F.when(kind == 1, F.array(ghost)).otherwise(F.array(ack))
    c = o.select(F.concat(F.lit("claim"), k).alias("claim_id"), F.concat(F.lit("m"), k).alias("corr_id"), F.lit(1).alias("seq"), F.lit("Title").alias("title"), F.lit("Odd Thing!").alias("kind"), F.lit("weird").alias("severity"), evidence.alias("evidence"), preds.alias("predicates"))
    lines = protocols.events(view(spark, sf_dir, "v_tx3").drop("t")).select("corr_id", "log_id", "raw", F.col("raw").alias("message"), F.lit("info").alias("level"), "stream", "source", "ts_ms")
    return c, lines


@query("select concat('claim', o_orderkey) as claim_id, case o_orderkey % 6 when 0 then case when o_orderkey % 17 = 0 then 'predicate failed' end when 1 then 'unknown log' when 2 then 'no positive evidence' when 3 then 'vacuous' when 5 then 'co-occurrence only' end as reason, 'medium' as severity, 'odd-thing' as kind from orders where o_orderkey % 11 <> 0")
def admit_claims(spark, sf_dir):
    return claims.admit(*_claims(spark, sf_dir)).select("claim_id", "reason", "severity", "kind")


@query("select v.corr_id, case when v.result = 'success' and c.corr_id is not null then 'ai_suspected' else v.result end as result from val v left join (select concat('m', o_orderkey) as corr_id from orders where o_orderkey % 11 <> 0 and (o_orderkey % 6 = 0 and o_orderkey % 17 <> 0 or o_orderkey % 6 = 4)) c on c.corr_id = v.corr_id", "v_tx3", "tx", "ruled", "sev", "val")
def apply_claims(spark, sf_dir):
    admitted = claims.admit(*_claims(spark, sf_dir))
    return claims.apply_review(validated(spark, sf_dir), admitted, admitted.select("corr_id")).select("corr_id", "result")


@query("select reason, count(*) as n from (select case o_orderkey % 6 when 0 then case when o_orderkey % 17 = 0 then 'predicate failed' end when 1 then 'unknown log' when 2 then 'no positive evidence' when 3 then 'vacuous' when 5 then 'co-occurrence only' end as reason from orders where o_orderkey % 11 <> 0) x where reason is not null group by 1 order by n desc, reason limit 10")
def rejected_claims(spark, sf_dir):
    r = claims.admit(*_claims(spark, sf_dir)).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return r.orderBy(F.desc("n"), "reason").limit(10)


# ---- telemetry and reports -----------------------------------------------------------------------------------------


@query("select count(*) as n, min(ts_ms) as first_ms, max(ts_ms) as last_ms from v_logs", "v_logs")
def log_totals(spark, sf_dir):
    return view(spark, sf_dir, "v_logs").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("select source, count(*) as n from v_logs group by 1", "v_logs")
def logs_by_source(spark, sf_dir):
    return view(spark, sf_dir, "v_logs").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select level, count(*) as n from p_logs group by 1", "v_logs", "p_logs")
def logs_by_level(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"select coalesce(application, 'unassigned') as application, severity, count(*) as n, count(*) filter (where created_at >= {_LATE} - 86400000) as recent from v_anomalies group by 1, 2", "v_anomalies")
def anomaly_totals(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies")
    end = a.agg(F.max("created_at")).first()[0] or 0
    return a.groupBy(F.coalesce("application", F.lit("unassigned")).alias("application"), "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at") >= end - 86_400_000).alias("recent"))


@query("select anomaly_id, severity from v_anomalies where fingerprint not like 'tx:%' and severity in ('high', 'critical')", "v_anomalies")
def alertable_anomalies(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies").where(~F.col("fingerprint").startswith("tx:"))
    return a.where(validation.meets(F.col("severity"), "high")).select("anomaly_id", "severity")


_CALLS = "count(*) as n, count(case when not ok then 1 end) as errors, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, quantile_cont(latency_ms, 0.5) as p50, quantile_cont(latency_ms, 0.95) as p95, max(latency_ms) as longest, round(avg(latency_ms), 4) as mean"


@query(f"select stage, {_CALLS}, count(case when not ok then 1 end) / count(*)::double as error_rate from v_calls_made group by stage", "v_calls_made")
def model_calls_by_stage(spark, sf_dir):
    c = view(spark, sf_dir, "v_calls_made")
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    g = c.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), p.alias("p"), F.max("latency_ms").alias("longest"), F.round(F.avg("latency_ms"), 4).alias("mean"))
    return g.withColumn("p50", F.col("p")[0]).withColumn("p95", F.col("p")[1]).withColumn("error_rate", F.when(F.col("n") > 0, F.col("errors") / F.col("n"))).drop("p")


@query("select model, coalesce(stop_reason, 'unknown') as stop_reason, count(*) as n from v_calls_made where ok group by 1, 2", "v_calls_made")
def stop_reasons(spark, sf_dir):
    return view(spark, sf_dir, "v_calls_made").where("ok").groupBy("model", F.coalesce("stop_reason", F.lit("unknown")).alias("stop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select id, at_ms, stage from v_calls_made where not ok order by at_ms desc, id limit 5", "v_calls_made")
def last_errors(spark, sf_dir):
    return view(spark, sf_dir, "v_calls_made").where(~F.col("ok")).orderBy(F.desc("at_ms"), "id").limit(5).select("id", "at_ms", "stage")


@query("select count(case when guardrail = 'BLOCKED' then 1 end) as blocked, count(case when guardrail is not null and guardrail is distinct from 'BLOCKED' then 1 end) as masked from v_calls_made", "v_calls_made")
def guardrail_counts(spark, sf_dir):
    g = F.col("guardrail")
    return view(spark, sf_dir, "v_calls_made").agg(F.count_if(g == "BLOCKED").alias("blocked"), F.count_if(g.isNotNull() & ~g.eqNullSafe("BLOCKED")).alias("masked"))


@query("select concat('policy', p) as policy, count(*) as n from (select unnest(range(0, policies)) as p from v_calls_made) x group by 1", "v_calls_made")
def policy_counts(spark, sf_dir):
    c = view(spark, sf_dir, "v_calls_made").where("policies > 0").select(F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("policies") - 1), lambda i: F.concat(F.lit("policy"), i))).alias("policy"))
    return c.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id % 3 as trigger, count(*) as runs, count(case when event_id % 4 = 0 then 1 end) as open, round(avg(case when event_id % 4 <> 0 then floor(value * 10) end), 4) as mean_ms from events group by 1")
def run_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    finished = F.col("event_id") % 4 != 0
    return e.groupBy((F.col("user_id") % 3).alias("trigger")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~finished).alias("open"), F.round(F.avg(F.when(finished, F.floor(F.col("value") * 10))), 4).alias("mean_ms"))


@query("select event_type as type, level, count(*) as n from p_logs p join (select event_id as e, event_type from events) x on x.e = p.event_id group by 1, 2", "v_logs", "p_logs")
def counts_by_type_and_level(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy(F.substring("stream", 6, 40).alias("type"), "level").agg(F.count(F.lit(1)).alias("n"))


_PHASES = "select concat('m', substr(log_id, 2)) as corr_id, t from v_tx3"


@query(f"select corr_id, string_agg(t, ',' order by t) as phases from ({_PHASES}) x group by 1", "v_tx3")
def phase_listing(spark, sf_dir):
    e = protocols.events(view(spark, sf_dir, "v_tx3").drop("t"))
    return e.groupBy("corr_id").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("phases"))


@query(f"select corr_id, case when n_ack = 0 and n_resp = 0 then 'ACK,RESPONSE' when n_ack = 0 then 'ACK' else 'RESPONSE' end as missing from (select corr_id, count(case when t = 'ACK' then 1 end) as n_ack, count(case when t = 'RESPONSE' then 1 end) as n_resp, count(case when t = 'REQUEST' then 1 end) as n_req from ({_PHASES}) x group by 1) y where n_req > 0 and (n_ack = 0 or n_resp = 0)", "v_tx3")
def incomplete_transactions(spark, sf_dir):
    e = protocols.events(view(spark, sf_dir, "v_tx3").drop("t")).groupBy("corr_id").agg(F.collect_set("type").alias("seen"))
    missing = F.array_except(F.array(*[F.lit(p) for p in XML.phases]), F.col("seen"))
    return e.where(F.array_contains("seen", "REQUEST") & (F.size(missing) > 0)).select("corr_id", F.array_join(missing, ",").alias("missing"))


@query("select type, count(*) as n from v_tx2 where type in ('REQUEST', 'RESPONSE') group by 1", "v_tx2")
def counts_by_phase(spark, sf_dir):
    return view(spark, sf_dir, "v_tx2").where(F.col("type").isin("REQUEST", "RESPONSE")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, bool_or(type = 'REQUEST') as has_request, bool_or(type = 'RESPONSE') as has_response, count(*) as n from v_tx2 group by 1", "v_tx2")
def transaction_status(spark, sf_dir):
    return view(spark, sf_dir, "v_tx2").groupBy("conv_id").agg(F.bool_or(F.col("type") == "REQUEST").alias("has_request"), F.bool_or(F.col("type") == "RESPONSE").alias("has_response"), F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, place from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as place from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) x where r <= 2) y")
def last_turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    newest = c.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("_r <= 2")
    return newest.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("select log_id, ts_ms from v_logs where source in ('splunk', 'email') and ts_ms between 1704067200000 and 1706000000000 order by ts_ms desc, log_id limit 200", "v_logs")
def newest_logs(spark, sf_dir):
    v = view(spark, sf_dir, "v_logs").where(F.col("source").isin("splunk", "email") & F.col("ts_ms").between(1704067200000, 1706000000000))
    return v.orderBy(F.desc("ts_ms"), "log_id").limit(200).select("log_id", "ts_ms")


@query("select corr_id, case when final = 'error' then last_activity + 1800000 else last_activity end as closed_at from ruled order by closed_at desc nulls last, corr_id limit 100", "v_tx3", "tx", "ruled")
def newest_closed(spark, sf_dir):
    return xml_transactions(spark, sf_dir).orderBy(F.col("closed_at").desc_nulls_last(), "corr_id").limit(100).select("corr_id", "closed_at")


@query("select e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.embedding is not null order by 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]), vec_id limit 20")
def vector_neighbours(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id = 0").first()
    return similarity.nearest(e, "embedding", list(q["embedding"]) if q else None, 20, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


# ---- state tables ---------------------------------------------------------------------------------------------------


@query("select concat('m', o_orderkey) as corr_id, case when o_orderkey % 2 = 0 or o_orderkey % 3 <> 0 then 'old-app' else 'new-app' end as application, case when o_orderkey % 3 = 0 then 'new' else 'old' end as status, case when o_orderkey % 3 = 0 and o_orderkey % 4 = 0 then 'N' when o_orderkey % 2 = 0 or o_orderkey % 3 <> 0 then 'O' end as ack_code from orders")
def upsert_transactions(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m"), k).alias("corr_id"), k)
    row = lambda df, app, status, code: df.select("corr_id", F.lit(app).alias("application"), F.lit(status).alias("status"), code.alias("ack_code"), F.lit("s").alias("source"), F.lit("g").alias("log_group"), F.lit(1).alias("first_seen_at"))
    old, new = row(o.where((k % 2 == 0) | (k % 3 != 0)), "old-app", "old", F.lit("O")), row(o.where(k % 3 == 0), "new-app", "new", F.when(k % 4 == 0, "N"))
    return tables.merge_transactions(old, new).select("corr_id", "application", "status", "ack_code")


@query("select concat('m', o_orderkey) as corr_id, case when o_orderkey % 5 = 0 then 'ai_suspected' else 'success' end as result, case when o_orderkey % 5 = 0 then 'old' else 'new' end as detail, case when o_orderkey % 5 = 0 then 200 end as reviewed_at from orders")
def upsert_validations(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m"), k).alias("corr_id"), k)
    row = lambda result, detail, at: o.select("corr_id", F.lit("xml").alias("application"), F.lit(1).alias("first_seen_at"), F.lit(result).alias("result"), F.lit(detail).alias("detail"), at.cast("int").alias("reviewed_at"))
    old, new = row("ai_suspected", "old", F.when(k % 5 == 0, 200).otherwise(50)), row("success", "new", F.lit(None))
    return tables.merge_validations(old, new, 100).select("corr_id", "result", "detail", "reviewed_at")


@query("select event_id as id, user_id % 2 as application, (epoch_us(ts) // 1000) as started_at, case when event_id % 4 = 0 then (epoch_us(ts) // 1000) + 5000 end as finished_at from events where event_id % 4 <> 0 or (epoch_us(ts) // 1000) + 5000 >= 1704600000000".replace("case when event_id % 4 = 0 then (epoch_us(ts) // 1000) + 5000 end", "case when event_id % 4 = 0 then (epoch_us(ts) // 1000) + 5000 when (epoch_us(ts) // 1000) < 1704686400000 - 600000 then 1704686400000 end"))
def run_lifecycle(spark, sf_dir):
    """Open and close records folded per run, stale ones closed, old closed ones dropped."""
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("application"), ms.alias("at"))
    opened = e.select("id", "application", "at", F.lit(None).cast("long").alias("finished_at"), F.lit(None).cast("long").alias("n"))
    closed = e.where("id % 4 = 0").select("id", "application", (F.col("at") + 5000).alias("at"), (F.col("at") + 5000).alias("finished_at"), F.lit(1).cast("long").alias("n"))
    runs = tables.fold_runs(opened.unionByName(closed))
    return tables.reap(runs, 1_704_686_400_000).select("id", "application", "started_at", "finished_at")


@query("select anomaly_id from (select anomaly_id, created_at from v_anomalies where created_at >= 1705000000000 and not regexp_matches(fingerprint, '^tx:.+:[0-9]{10,}$') order by created_at desc, anomaly_id limit 500) x", "v_anomalies")
def retained_anomalies(spark, sf_dir):
    a = tables.without_suffixed(tables.prune(view(spark, sf_dir, "v_anomalies"), "created_at", 1_705_000_000_000))
    return tables.keep_newest(a, 500, F.desc("created_at"), F.col("anomaly_id")).select("anomaly_id")


@query("select anomaly_id, concat('alert-', anomaly_id) as alert_id from v_anomalies where severity in ('high', 'critical') and created_at >= 1705000000000", "v_anomalies")
def cascaded_alerts(spark, sf_dir):
    a = view(spark, sf_dir, "v_anomalies")
    alerts = a.where(F.col("severity").isin("high", "critical")).select("anomaly_id", F.concat(F.lit("alert-"), "anomaly_id").alias("alert_id"))
    return tables.cascade(alerts, tables.prune(a, "created_at", 1_705_000_000_000))


@query("select event_id from events where event_id % 3 = 0 and event_id % 2 = 1")
def absent_runs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return tables.absent(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), "event_id")


def _redacted(x: str) -> str:
    for p, m in P.SECRETS:
        x = f"regexp_replace({x}, {_q(p)}, '{m}', 'g')"
    return x


_HASH = "sha256(doc_id::varchar)"
_SECRETS = f"concat(text, case when doc_id % 7 = 0 then concat(' Authorization: Bearer ', {_HASH}) end, case when doc_id % 11 = 0 then concat(' eyJ', substr({_HASH}, 1, 12), '.', substr({_HASH}, 13, 12), '.', substr({_HASH}, 25, 12)) end, case when doc_id % 9 = 0 then concat(' aws_secret_access_key = ', substr({_HASH}, 1, 40)) end)"


@query(f"select doc_id, regexp_matches(concat(text, case when doc_id % 13 = 0 then '-----BEGIN RSA PRIVATE KEY-----' end), {_q(P.PRIVATE_KEY)}) as blocked, md5({_redacted(_SECRETS)}) as redacted from documents")
def redacted_documents(spark, sf_dir):
    """Every document; some hold a token of each kind besides their own secrets."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    k = F.col("doc_id")
    token = F.when(k % 7 == 0, F.concat(F.lit(" Authorization: Bearer "), h)).otherwise("")
    jwt = F.when(k % 11 == 0, F.concat(F.lit(" eyJ"), F.substring(h, 1, 12), F.lit("."), F.substring(h, 13, 12), F.lit("."), F.substring(h, 25, 12))).otherwise("")
    aws = F.when(k % 9 == 0, F.concat(F.lit(" aws_secret_access_key = "), F.substring(h, 1, 40))).otherwise("")
    key = F.when(k % 13 == 0, "-----BEGIN RSA PRIVATE KEY-----").otherwise("")
    return d.select("doc_id", parsing.has_private_key(F.concat("text", key)).alias("blocked"), F.md5(parsing.redact_secrets(F.concat("text", token, jwt, aws))).alias("redacted"))


@query("select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(cast((epoch_us(ts) // 1000) % 1000 as varchar), 3, '0'), 'Z') as at, case when user_id % 1440 = 0 then concat(user_id // 1440, ' days') when user_id % 60 = 0 then concat(user_id // 60, ' hours') else concat(user_id, ' minutes') end as took from events")
def report_times(spark, sf_dir):
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parsing.iso_time(ms).alias("at"), parsing.humanised_minutes(F.col("user_id")).alias("took"))
