"""Log, transaction and call views derived from the given tables, by one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MESSAGES = (
    "Unhandled exception in payment worker", "read timed out after waiting for ledger", "connection refused by peer", "circuit breaker open for pricing",
    "access denied for caller", "too many requests from tenant", "disk full on volume", "process exited with code 137",
    "checksum mismatch in batch", "request accepted", "cache warmed", "heartbeat ok",
)
_MESSAGE = "case event_id % 12 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MESSAGES)) + " end"

#: @ms(x) stands for a timestamp's epoch milliseconds.
VIEWS = {
    "v_logs": f"""
select event_id, concat('l', event_id) as log_id, source, concat('/app/', event_type) as stream, ts_ms, user_id,
  case event_id % 3
    when 0 then concat('{{"level":"', lvl, '","message":"', msg, '","requestId":"req-', rid, '","service":"svc', user_id % 7, '","status":', status, ',"latency":', latency, '}}')
    when 1 then concat('level=', lvl, ' msg="', msg, '" request_id=req-', rid, ' service=svc', user_id % 7, ' status=', status, ' took=', latency, 'ms')
    else concat(msg, ' request_id: req-', rid, ' host: node', user_id % 5, ' from 10.0.', user_id % 200, '.', event_id % 250, ' status: ', status, ' took ', latency, ' ms')
  end as raw
from (
  select event_id, user_id, event_type, @ms(ts) as ts_ms, cast(floor(value * 20) as bigint) as latency, cast(floor(event_id / 3.0) as bigint) as rid,
    case user_id % 4 when 0 then 'cloudwatch' when 1 then 'splunk' when 2 then 'grafana' else 'email' end as source,
    {_MESSAGE} as msg, case when event_id % 12 < 9 then 'error' else 'info' end as lvl,
    case event_id % 9 when 0 then 500 when 1 then 404 when 2 then 401 when 3 then 429 else 200 end as status
  from events) x""",
    "v_tx3": """
select concat(kind, o_orderkey) as log_id, '/app/payments' as stream, 'cloudwatch' as source, ts_ms, type as t,
  concat('<ns2:cashMessage><messageType>', type, '</messageType><messageId>', kind, o_orderkey, '</messageId>',
    case when type = 'REQUEST' then '' else concat('<initMessageId>m', o_orderkey, '</initMessageId><ackCode>', code, '</ackCode>') end, '</ns2:cashMessage>') as raw
from (
  select o_orderkey, 'm' as kind, 'REQUEST' as type, @ms(o_orderdate) as ts_ms, '' as code from orders
  union all
  select o_orderkey, 'a', 'ACK', @ms(o_orderdate) + (o_orderkey % 60) * 60000, case when o_orderkey % 17 = 0 then 'FAILED' else 'OK' end from orders where o_orderkey % 11 <> 0
  union all
  select o_orderkey, 'r', 'RESPONSE', @ms(o_orderdate) + (o_orderkey % 60 + o_custkey % 50) * 60000, 'COMPLETED' from orders where o_orderkey % 13 <> 0) x""",
    "v_calls": """
select concat(kind, o_orderkey) as log_id, stream, 'cloudwatch' as source, ts_ms, raw, o_orderkey
from (
  select o_orderkey, 'h' as kind, '/app/calls' as stream, @ms(o_orderdate) as ts_ms,
    concat('2024-01-01T00:00:00Z INFO correlationID: c', o_orderkey, '; FedLine Request: RequestId: 0000000000000000', o_orderkey) as raw from orders
  union all
  select o_orderkey, 'g', '/gateway/calls', @ms(o_orderdate) + 1000,
    concat('(00000000', o_orderkey, ') X-Correlation-ID=c', o_orderkey, ' x-amzn-RequestId=0000000000000000', case when o_orderkey % 50 = 0 then o_orderkey + 1 else o_orderkey end) from orders
  union all
  select o_orderkey, 's', '/gateway/calls', @ms(o_orderdate) + 2000,
    concat('(00000000', o_orderkey, ') Method completed with status: ', case when o_orderkey % 10 = 0 then 500 else 200 end) from orders where o_orderkey % 9 <> 0) x""",
    "v_lines": """
select doc_id, source as stream, line_no, case when line_no = 1 then concat('2024-01-01T00:00:00Z ', line) else line end as raw from (
  select doc_id, source, @unnest(text)) x""",
    "v_tx2": """
select conv_id, turn, case role when 'user' then 'REQUEST' when 'assistant' then 'RESPONSE' end as type, text from conversations where role in ('user', 'assistant')""",
    "v_anomalies": """
select concat('a', event_id) as anomaly_id, @ms(ts) as created_at, case when user_id % 3 = 0 then null when user_id % 3 = 1 then 'xml' else 'calls' end as application,
  case when event_id % 4 = 0 then concat('tx:m', cast(floor(event_id / 4.0) as bigint)) else concat('fp', event_id % 97) end as fingerprint,
  case event_id % 5 when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end as severity,
  concat('l', event_id) as log_id, event_id
from events""",
    "v_calls_made": """
select event_id as id, @ms(ts) as at_ms, case event_id % 3 when 0 then 'ingest' when 1 then 'validate' else 'chat' end as stage, concat('model-', user_id % 2) as model,
  event_type <> 'error' as ok, cast(floor(value * 10) as bigint) as latency_ms, user_id * 3 as tokens_in, user_id as tokens_out,
  case event_id % 7 when 0 then null when 1 then 'max_tokens' else 'end_turn' end as stop_reason,
  case event_id % 13 when 0 then 'BLOCKED' when 1 then 'MASKED' else null end as guardrail, event_id % 6 as policies
from events""",
}


def _sql(name: str, engine: str) -> str:
    ms = {"spark": r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(\1 as timestamp_ntz))", "duckdb": r"(epoch_us(\1) // 1000)"}[engine]
    text = re.sub(r"@ms\((\w+)\)", ms, VIEWS[name])
    if engine == "spark":
        text = text.replace("source, @unnest(text)) x", "source, pos + 1 as line_no, line from documents lateral view posexplode(split(text, '\n')) p as pos, line) x")
    return text.replace("@unnest(text)) x", "unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents) x")


def duckdb_sql(name: str) -> str:
    return _sql(name, "duckdb")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _sql(name, "spark")
    tables = [t for t in ("events", "orders", "documents", "conversations") if re.search(rf"\bfrom {t}\b", text)]
    for t in tables:
        text = re.sub(rf"\bfrom {t}\b", f"from parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)
