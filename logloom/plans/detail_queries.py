"""Queries of rules and extractors on inputs in which each of their cases occurs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import parsing, protocols
from logloom.functions import patterns as P
from logloom.operators import claims, reports, similarity, tables, transactions, validation
from logloom.plans.queries import EXTRA, XML, _q, query
from logloom.plans.views import view

AT, OPENS = 1_000_000_000_000, 900_000_000_000

#: Orders as transactions in every state: phases by remainders, some before the window of known lines, some still active.
EXTRA["states"] = f"""
select *, case when status = 'completed' then 1 else 0 end as done, (case when rq is null then 0 else 1 end + case when ac is null then 0 else 1 end + case when rs is null then 0 else 1 end) as n_seen,
  case when rs is not null and ac is not null then rs - ac when ac is not null and active then {AT} - ac end as latency, greatest(coalesce(rq, 0), coalesce(ac, 0), coalesce(rs, 0), spawned) as last
from (select concat('s', o_orderkey) as corr_id, o_orderkey as k, o_orderkey % 8 = 7 as active, case when o_orderkey % 8 = 7 then 'awaiting' when o_orderkey % 8 = 6 then 'failed' when o_orderkey % 8 = 5 then 'error' else 'completed' end as status,
  case when o_orderkey % 2 = 0 then {OPENS} + 1 else {OPENS} - 5000 end as spawned, case when o_orderkey % 3 <> 0 then {AT} - 7200000 end as rq, case when o_orderkey % 5 <> 0 then {AT} - 3600000 end as ac, case when o_orderkey % 7 <> 0 and o_orderkey % 8 <> 7 then {AT} - 3600000 + (o_orderkey % 40) * 60000 end as rs,
  case when o_orderkey % 11 = 0 then 1 else 0 end as n_failing, case when o_orderkey % 13 < 4 then null else 'OK' end as ack_code, case when o_orderkey % 6 = 1 then 'high' when o_orderkey % 6 = 2 then 'medium' end as sev from orders) o"""
_DERIVED = "case when n_failing > 0 then 'failed' when rs is not null then 'completed' else 'unknown' end"
_EXPECTED = "case status when 'failed' then 'high' when 'error' then 'medium' end"
_LATE = "coalesce(latency > 1800000, false)"
_GAPS = "concat_ws(',', case when rq is null and (ac is not null or rs is not null) then 'REQUEST' end, case when ac is null and rs is not null then 'ACK' end)"
_STUCK = f"ac is null and {AT} - last > 1800000"
_DELTAS = f"""select *, {_DERIVED} as derived, case when active then concat_ws('; ', case when {_LATE} then 'overdue' when {_STUCK} then 'stuck' end) else concat_ws('; ',
  case when {_EXPECTED} is not null and sev is null then concat('missing anomaly: ', {_EXPECTED}) when {_EXPECTED} is null and sev is not null then concat('unexpected anomaly: ', sev) when {_EXPECTED} <> sev then concat('wrong level: ', sev) end,
  case when done = 1 and n_seen < 3 then concat('missing phases: ', concat_ws(',', case when rq is null then 'REQUEST' end, case when ac is null then 'ACK' end, case when rs is null then 'RESPONSE' end)) end,
  case when done = 1 and {_LATE} then concat('SLA breach: ', floor(latency / 60000.0 + 0.5)::bigint) end,
  case when {_DERIVED} = 'failed' and done = 1 then 'status mismatch: failed' when {_DERIVED} = 'completed' and status in ('failed', 'error') then 'status mismatch: completed' end,
  case when spawned >= {OPENS} and done = 1 and rq is not null and rs is null then 'unverified completion' end,
  case when spawned >= {OPENS} and done = 1 and n_seen > 0 and {_GAPS} <> '' then concat('incomplete evidence: ', {_GAPS}) end) end as delta from states"""


def _states(spark, sf_dir):
    k = F.col("o_orderkey")
    rest = k % 8
    status = F.when(rest == 7, "awaiting").when(rest == 6, "failed").when(rest == 5, "error").otherwise("completed")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("s"), k).alias("corr_id"), F.lit("xml").alias("application"), (rest == 7).alias("active"), status.alias("status"), F.when(k % 2 == 0, OPENS + 1).otherwise(OPENS - 5000).alias("spawned_at"),
        F.when(k % 3 != 0, F.lit(AT - 7_200_000)).alias("ts_REQUEST"), F.when(k % 5 != 0, F.lit(AT - 3_600_000)).alias("ts_ACK"), F.when((k % 7 != 0) & (rest != 7), AT - 3_600_000 + (k % 40) * 60_000).alias("ts_RESPONSE"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("n_failing"), F.when(k % 13 >= 4, "OK").alias("ack_code"), F.when(k % 6 == 1, "high").when(k % 6 == 2, "medium").alias("actual_severity"), F.lit(None).cast("array<string>").alias("quality"),
    )
    last = F.greatest(*[F.coalesce(f"ts_{p}", F.lit(0)) for p in XML.phases], "spawned_at")
    o = o.withColumn("missing", transactions.missing_phases(XML)).withColumn("last_activity", last)
    return validation.validate(validation.derive_outcome(o, XML), XML, AT, OPENS)


@query(f"select corr_id, delta, case when active then {_LATE} or ({_STUCK}) else {_LATE} end as sla_breached, case when active then 'pending' when delta <> '' then 'failure' else 'success' end as result from ({_DELTAS}) d", "states")
def validation_deltas(spark, sf_dir):
    """Every rule's text on transactions in which each of them fires: active, incomplete, late, contradicted, outside the known window."""
    return _states(spark, sf_dir).select("corr_id", F.array_join("delta", "; ").alias("delta"), "sla_breached", "result")


@query(f"select corr_id, case when derived = 'unknown' then 'outcome unproven' else 'no code recorded' end as reason from ({_DELTAS}) d where not active and status = 'completed' and delta = '' and (derived = 'unknown' or ack_code is null)", "states")
def residual_transactions(spark, sf_dir):
    return validation.residual(_states(spark, sf_dir)).select("corr_id", "reason")


_CODES = ("OK", "ok", "Accepted", "COMPLETED", "complete", "FAILED", "processed_successfully", "200", "399", "404", "500", "9999", "success", "successful", " 201 ", "no", "")
_CODE = "case o_orderkey % 18 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CODES)) + " end"


@query(f"select o_orderkey, coalesce(code = '' or regexp_matches(code, {_q(P.XML_OK)}), true) as xml_ok, coalesce(code = '' or case when regexp_matches(trim(code), '^[0-9]{{3}}$') then trim(code)::int < 400 else regexp_matches(trim(code), {_q(P.CALL_OK)}) end, true) as call_ok from (select o_orderkey, {_CODE} as code from orders) o")
def code_outcomes(spark, sf_dir):
    """Codes of both protocols: words in any case, HTTP statuses, blanks and none."""
    i = F.col("o_orderkey") % 18
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), i.cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", code.alias("code"))
    return o.select("o_orderkey", protocols.xml_success(F.col("code")).alias("xml_ok"), protocols.call_success(F.col("code")).alias("call_ok"))


@query("select o_orderkey as k, case o_orderkey % 4 when 0 then 'calls' when 1 then 'calls' when 2 then 'xml' end as application, case o_orderkey % 4 when 0 then 'RESPONSE' when 1 then 'REQUEST' when 2 then 'ACK' end as type, case o_orderkey % 4 when 0 then concat('j', o_orderkey) when 1 then concat('q', o_orderkey) when 2 then concat('m', o_orderkey) end as corr_id, case o_orderkey % 4 when 0 then (400 + o_orderkey % 200)::varchar when 2 then 'OK' end as ack_code from orders where o_orderkey % 4 <> 3")
def events_by_content(spark, sf_dir):
    """Lines of a log group that no application owns, told by their content: JSON with two spellings of its fields, XML, and others."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.format_string('{"messageType":"response","correlationId":"j%s","status":%s}', k, 400 + k % 200)).when(k % 4 == 1, F.format_string('  {"type":"Request","id":"q%s"}', k))
        .when(k % 4 == 2, F.format_string("<a:messageType> ack </a:messageType><messageId>x%s</messageId><initMessageId>m%s</initMessageId><ackCode>OK</ackCode>", k, k)).otherwise(F.format_string('{"type":"note","id":"n%s"}', k))
    )
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.lit("/elsewhere").alias("stream"), text.alias("raw"))
    return protocols.events(lines).select("k", "application", "type", "corr_id", "ack_code")


_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))"


@query(f"select k, ids from (select o_orderkey as k, case o_orderkey % 3 when 0 then concat('req:', {_UUID}) when 1 then concat('corr:A', o_orderkey, ',req:', substr(h, 1, 16), ',trace:1-', substr(h, 1, 8), '-', substr(h, 9, 24)) else concat('req:', substr(h, 1, 8), ',req:', substr(h, 3, 20)) end as ids from (select o_orderkey, md5(o_orderkey::varchar) as h from orders) x) y")
def identifier_kinds(spark, sf_dir):
    """All kinds of identifiers: a leading request id, one in parentheses, echoed ones, a trace and a business id."""
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit("2024-01-01T00:00:00Z "), F.upper(uuid), F.lit(" INFO start")))
        .when(k % 3 == 1, F.concat(F.lit("X-Correlation-ID = A"), k, F.lit("; x-amzn-RequestId="), cut(1, 16), F.lit(" Root=1-"), cut(1, 8), F.lit("-"), cut(9, 24)))
        .otherwise(F.concat(F.lit("("), cut(1, 8), F.lit(") RequestId: "), F.upper(cut(3, 20))))
    )
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), raw.alias("raw"))
    return lines.select("k", F.array_join(protocols.call_ids(F.col("raw")), ",").alias("ids"))


_NOTED = "select doc_id, concat(coalesce(text, ''), ' error_code=E', doc_id, ' see https://x.example/', doc_id, ' mail a', doc_id, '@b.example ', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) as raw from (select *, md5(doc_id::varchar) as h from documents) d"
_KINDS = "uuid", "email", "url", "errorCode"


@query("select doc_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(raw, {_q(P.ENTITIES[k][0])}, {P.ENTITIES[k][1]}), lambda x: trim(x)))), ' ') as \"{k}\"" for k in _KINDS) + f" from ({_NOTED}) n")
def document_entities(spark, sf_dir):
    """Ids, addresses and links in whole documents, with one of each kind added to every text."""
    h = F.md5(F.col("doc_id").cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    d = F.col("doc_id")
    raw = F.concat(F.coalesce("text", F.lit("")), F.lit(" error_code=E"), d, F.lit(" see https://x.example/"), d, F.lit(" mail a"), d, F.lit("@b.example "), uuid)
    e = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", parsing.entities(raw).alias("e"))
    return e.select("doc_id", *[F.coalesce(F.array_join(F.array_sort(F.col("e")[k]), " "), F.lit("")).alias(k) for k in _KINDS])


@query("select concat('b', o_orderkey) as corr_id, concat_ws(',', case when o_orderkey % 2 = 0 then concat('REQUEST=', o_orderkey) end, case when o_orderkey % 3 = 0 then concat('ACK=', o_orderkey + 1) end, case when o_orderkey % 5 = 0 then concat('RESPONSE=', o_orderkey + 2) end) as phases, case o_orderkey % 3 when 0 then 'awaiting' when 1 then 'error' else 'completed' end as status from orders")
def backfilled_phases(spark, sf_dir):
    k = F.col("o_orderkey")
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("b"), k).alias("corr_id"), F.when(k % 2 == 0, k).alias("request_ts"), F.when(k % 3 == 0, k + 1).alias("ack_ts"), F.when(k % 5 == 0, k + 2).alias("response_ts"), F.when(k % 3 == 0, "awaiting_ack").when(k % 3 == 1, "timeout").otherwise("completed").alias("status"))
    entries = F.transform(F.map_entries("phase_ts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return tables.backfill_phases(old).select("corr_id", F.array_join(entries, ",").alias("phases"), "status")


@query("select corr_id, excerpt from (select concat('m', substr(log_id, 2)) as corr_id, substr(raw, 1, 60) as excerpt, row_number() over (partition by substr(log_id, 2) order by ts_ms, log_id) as r from v_tx3) x where r = 1", "v_tx3")
def evidence_excerpts(spark, sf_dir):
    e = protocols.events(view(spark, sf_dir, "v_tx3").drop("t"), (XML,))
    return transactions.evidence_lines(e, F.lit(False), limit=1, cut=60).select("corr_id", "excerpt")


def _xml_events(spark, sf_dir):
    return protocols.events(view(spark, sf_dir, "v_tx3").drop("t"), (XML,))


@query("select * from (select t as type, count(*) over (partition by t) as n, row_number() over (partition by t order by ts_ms, log_id) as place, log_id from v_tx3 where t in ('ACK', 'RESPONSE')) x where place <= 200", "v_tx3")
def messages_by_phase(spark, sf_dir):
    return reports.by_phase(_xml_events(spark, sf_dir), ("ACK", "RESPONSE")).select("type", "n", "place", "log_id")


@query("select corr_id, concat('REQUEST+', case when a then concat(' ACK+', code) else ' ACK-' end, case when r then ' RESPONSE+COMPLETED' else ' RESPONSE-' end) as phases, concat_ws('; ', case when code = 'FAILED' then 'failed: ACK' end, case when not a or not r then concat('incomplete: ', concat_ws(',', case when not a then 'ACK' end, case when not r then 'RESPONSE' end)) end) as notes from (select concat('m', substr(log_id, 2)) as corr_id, bool_or(t = 'ACK') as a, bool_or(t = 'RESPONSE') as r, max(case when t = 'ACK' then regexp_extract(raw, '<ackCode>([A-Z]+)</ackCode>', 1) end) as code from v_tx3 group by 1) x", "v_tx3")
def status_reports(spark, sf_dir):
    return reports.status_of(_xml_events(spark, sf_dir), XML)


_OPS = (
    ("raw", "contains", "<ackcode>ok"), ("level", "equals", "info"), ("level", "equals", "INFO"), ("stream", "equals", "/app/payments"), ("source", "contains", "CLOUD"), ("timestamp", "gt", "0"), ("timestamp", "lt", "0"),
    ("message", "matches", "ack(code)?>(ok|failed)"), ("raw", "matches", "failed<"), ("raw", "not_contains", "failed"), ("message", "gt", "1"), ("raw", "matches", "x" * 201),
)
EXTRA["predicates"] = "select o_orderkey as k, i, concat('a', o_orderkey) as log_id, case (o_orderkey + i) % 12 " + " ".join(f"when {n} then '{f}'" for n, (f, _, _) in enumerate(_OPS)) + " end as field, case (o_orderkey + i) % 12 " + " ".join(f"when {n} then '{o}'" for n, (_, o, _) in enumerate(_OPS)) + " end as op, case (o_orderkey + i) % 12 " + " ".join(f"when {n} then '{v}'" for n, (_, _, v) in enumerate(_OPS)) + " end as value from orders, unnest(range(0, case when o_orderkey % 13 = 0 then 12 else 1 + o_orderkey % 3 end)) u(i) where o_orderkey % 11 <> 0"


@query(
    """select claim_id, case when seq > 3 then 'too many claims' when n > 10 then 'too many predicates' when only_absent then 'no positive evidence' when repeats then 'co-occurrence only' when not holds then 'predicate failed' end as reason from (
  select concat('c', k, '-', seq) as claim_id, seq, n, only_absent, repeats, holds from (
    select k, count(*) as n, bool_and(op = 'not_contains') as only_absent, count(distinct concat_ws('|', field, op, lower(value))) < count(*) as repeats, bool_and(ok) as holds from (
      select p.*, coalesce(case op when 'contains' then contains(lower(s), lower(value)) when 'not_contains' then not contains(lower(s), lower(value)) when 'equals' then s = value when 'lt' then try_cast(s as double) < try_cast(value as double)
        when 'gt' then try_cast(s as double) > try_cast(value as double) when 'matches' then length(value) <= 200 and regexp_matches(s, concat('(?i)', value)) end, false) as ok
      from (select p.*, case field when 'raw' then raw when 'message' then raw when 'level' then 'info' when 'stream' then stream when 'source' then source when 'timestamp' then ts_ms::varchar end as s from predicates p join v_tx3 v on v.log_id = p.log_id) p) q group by k) g, unnest(range(1, case when k % 5 = 0 then 5 else 2 end)) u(seq)) c""",
    "v_tx3", "predicates",
)
def claims_of_every_kind(spark, sf_dir):
    """Claims with one to twelve predicates of all operators over all fields, several claims for one transaction among them."""
    k = F.col("k")
    given = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(o).alias("op"), F.lit(v).alias("value")) for f, o, v in _OPS])
    many = F.when(k % 13 == 0, 12).otherwise(1 + k % 3)
    preds = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda i: F.struct(F.concat(F.lit("a"), k).alias("log_id"), F.get(given, ((k + i) % 12).cast("int"))["field"].alias("field"), F.get(given, ((k + i) % 12).cast("int"))["op"].alias("op"), F.get(given, ((k + i) % 12).cast("int"))["value"].alias("value")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"))
    c = o.withColumn("seq", F.explode(F.sequence(F.lit(1), F.when(k % 5 == 0, 4).otherwise(1)))).select(
        F.concat(F.lit("c"), k, F.lit("-"), "seq").alias("claim_id"), F.concat(F.lit("m"), k).alias("corr_id"), "seq", F.lit("Title").alias("title"), F.lit("odd").alias("kind"), F.lit("low").alias("severity"),
        F.array(F.concat(F.lit("a"), k)).alias("evidence"), preds.alias("predicates"),
    )
    lines = _xml_events(spark, sf_dir).select("corr_id", "log_id", "raw", F.col("raw").alias("message"), F.lit("info").alias("level"), "stream", "source", "ts_ms")
    return claims.admit(c, lines).select("claim_id", "reason")


@query("select vec_id, round(distance, 6) as distance from (select e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as distance from embeddings e, (select embedding from embeddings where vec_id = 1) q where e.embedding is not null and e.label = 1 order by distance, e.vec_id limit 20) x")
def filtered_neighbours(spark, sf_dir):
    """The nearest of one label: the filter comes before the ranking."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    q = e.where("vec_id = 1").first()
    return similarity.nearest(e.where("label = 1"), "embedding", list(q["embedding"]) if q else None, 20, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("select log_id, ts_ms from v_logs where source = 'splunk' order by ts_ms desc, log_id limit 20", "v_logs")
def newest_without_a_vector(spark, sf_dir):
    logs = view(spark, sf_dir, "v_logs").where("source = 'splunk'")
    return similarity.nearest(logs, "raw", None, 20, "log_id", F.col("ts_ms")).select("log_id", "ts_ms")
