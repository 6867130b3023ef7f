import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from logloom import sources, streaming
from logloom.functions import parsing, protocols
from logloom.operators import identity, logs, tables, telemetry, validation


def parse_one(spark, raw, attributes=None):
    df = spark.createDataFrame([("cloudwatch", "s", 1, raw, attributes or {})], sources.RECORD)
    return parsing.parse(df).first()


def test_parse_json_logfmt_and_text(spark):
    r = parse_one(spark, '{"level":"error","message":"payment gateway timeout","requestId":"abc-123"}')
    assert (r.level, r.message, r.entities["requestId"]) == ("error", "payment gateway timeout", ["abc-123"])
    r = parse_one(spark, "a=1 b=2 a=3 msg='hi there'", {"b": "9"})
    assert (r.message, r.fields["a"], r.fields["b"]) == ("hi there", "3", "9")
    r = parse_one(spark, "request_id=req-99 from 8.8.8.8 status=500")
    assert r.entities["ip"] == ["8.8.8.8"] and r.entities["requestId"] == ["req-99"] and r.status_code == 500
    assert parse_one(spark, "{broken").message == "{broken"
    assert parse_one(spark, "GET /x 200 in 456 ms").template == "GET /x <num> in <num> ms"
    assert parse_one(spark, "took 2 s").latency_ms == 2000.0
    assert parse_one(spark, "é42 x").template == "é<num> x"


def test_same_fingerprint(spark):
    a, b = (parse_one(spark, t).fingerprint for t in ("user 42 failed login from 10.0.0.1", "user 9931 failed login from 192.168.1.7"))
    assert a == b


def test_entries_do_not_span_streams(spark):
    lines = [("a", 1, "2024-01-01T00:00:00Z head"), ("b", 2, "2024-01-01T00:00:00Z other"), ("a", 3, "tail"), ("a", 4, "START RequestId: x"), ("b", 5, "more")]
    df = spark.createDataFrame(lines, "stream string, seq int, raw string")
    got = {(r.stream, r.entry): (r.n_lines, r.raw) for r in logs.entries(df, ["seq"]).collect()}
    assert got == {("a", 1): (2, "2024-01-01T00:00:00Z head\ntail"), ("a", 2): (1, "START RequestId: x"), ("b", 1): (2, "2024-01-01T00:00:00Z other\nmore")}
    strict = {(r.stream, r.entry): r.n_lines for r in logs.entries(df, ["seq"], strict_adjacency=True).collect()}
    assert strict[("a", 1)] == 1
    forced = logs.entries(df, ["seq"], starts=F.col("raw") == "tail").count()
    assert forced == 4


def test_xml_and_call_events(spark):
    raws = ["<ns2:cashMessage><messageType>ack</messageType><messageId>a1</messageId><initMessageId>m1</initMessageId><ackCode> OK </ackCode></x>", '{"messageType":"response","correlationId":"c9","status":502}', "INFO correlationID: request-7; Response from Data Services"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    x = [tuple(r) for r in df.select(*[protocols.xml_event(F.col("raw"))[k] for k in ("type", "corr_id", "ack_code")]).collect()]
    c = [tuple(r) for r in df.select(*[protocols.call_event(F.col("raw"))[k] for k in ("type", "corr_id", "ack_code")]).collect()]
    assert x[0] == ("ACK", "m1", "OK") and x[1] == (None, None, None)
    assert c[1] == ("RESPONSE", "c9", "502") and c[2] == ("RESPONSE", "request-7", None)


def test_identity_never_joins_two_business_ids(spark):
    shared = "0000000000000000ab"
    lines = [
        ("1", 1, f"INFO correlationID: A; RequestId: {shared}"), ("2", 2, f"INFO correlationID: B; RequestId: {shared}"),
        ("3", 3, f"(12345678) X-Correlation-ID=A x-amzn-RequestId={shared}"), ("4", 4, "(12345678) Method completed with status: 500"),
    ]
    df = spark.createDataFrame(lines, "log_id string, ts_ms long, raw string")
    calls = identity.call_map(df)
    m = {r.id: r.call for r in calls.collect()}
    assert m["corr:A"] != m["corr:B"] and m["req:12345678"] == m["corr:A"]
    out = {r.call: r.http_status for r in identity.http_outcomes(identity.related_lines(df, calls)).collect()}
    assert out["corr:A"] == 500 and out.get("corr:B") is None


def events(*rows):
    return pd.DataFrame([{"ts_ms": t, "log_id": f"l{t}", "type": k, "application": "xml", "ack_code": c} for t, k, c in rows])


def test_state_is_the_same_for_any_split():
    seq = events((1, "REQUEST", None), (2, "ACK", "OK"), (5, "RESPONSE", "COMPLETED"))
    step = lambda s, e, now: streaming.advance(s, e, ("REQUEST", "ACK", "RESPONSE"), lambda c: c == "FAILED", now, 100)
    whole = step(None, seq, 10)
    parts = None
    for i in range(3):
        parts = step(parts, seq.iloc[i : i + 1], 10)
    assert whole == parts and whole["status"] == "completed"
    none = seq.iloc[:0]
    waiting = step(None, seq.iloc[:1], 10)
    assert step(waiting, none, 90)["status"] == "awaiting" and step(waiting, none, 111)["status"] == "error"
    failed = step(waiting, events((3, "ACK", "FAILED")), 10)
    assert failed["status"] == "failed" and step(failed, seq, 10) == failed
    assert step(None, seq.iloc[2:], 10)["status"] == "undecided"


def test_sources(spark, tmp_path):
    (tmp_path / "cw.json").write_text('{"logGroupName":"/sim/a","logStreamName":"x","timestamp":5,"message":"hello"}\n{"logGroupName":"/other","logStreamName":"x","timestamp":6,"message":"no"}\n')
    (tmp_path / "sp.json").write_text('{"result":{"_raw":"line","_time":"1.5","host":"h"}}\nnot json\n')
    (tmp_path / "loki.json").write_text('{"data":{"result":[{"stream":{"app":"x"},"values":[["1999999","a"],["3000000","b"]]}]}}')
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "m1").write_bytes(b"From: a\r\n\r\nsoft=\r\nwrap ")
    cw = sources.read_cloudwatch(spark, str(tmp_path / "cw.json"), groups=["/sim/*", "/sim/*"])
    assert [(r.stream, r.ts_ms) for r in cw.collect()] == [("/sim/a", 5)]
    assert {(r.raw, r.ts_ms) for r in sources.read_splunk(spark, str(tmp_path / "sp.json"), 77).collect()} == {("line", 1500), ("not json", 77)}
    assert [(r.ts_ms, r.raw) for r in sources.read_loki(spark, str(tmp_path / "loki.json")).collect()] == [(1, "a"), (3, "b")]
    mail = sources.read_email(spark, str(tmp_path / "mail"))
    assert mail.first().raw == "softwrap"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json.gz").write_bytes(b"not a gzip file")
    readers = {"cloudwatch": lambda: cw, "none": lambda: spark.read.json(str(tmp_path / "missing")), "corrupt": lambda: sources.read_cloudwatch(spark, str(tmp_path / "bad")), "email": lambda: mail}
    both, errors = sources.all_sources(spark, readers, str(tmp_path / "out"))
    assert both.count() == 2 and {r.source for r in errors.collect()} == {"none", "corrupt"}
    good, bad = sources.valid(both.withColumn("source", F.when(F.col("source") == "email", "fax").otherwise(F.col("source"))))
    assert good.count() == 1 and bad.count() == 1


def test_tables(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "fingerprint string, first_seen int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "fingerprint string, first_seen int")
    once = tables.merge_baselines(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in tables.merge_baselines(once, new).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    df = spark.createDataFrame([(1, None, 3, "awaiting_ack"), (None, None, None, "timeout")], "request_ts int, ack_ts int, response_ts int, status string")
    assert [(r.phase_ts, r.status) for r in tables.backfill_phases(df).collect()] == [({"REQUEST": 1, "RESPONSE": 3}, "awaiting"), ({}, "error")]


def test_severity(spark):
    df = spark.createDataFrame([(["low", "critical", "info"],), ([],)], "s array<string>").select(validation.worst(F.col("s")).alias("w"))
    assert [r.w for r in df.collect()] == ["critical", None]


def test_hooks(spark):
    t = spark.createDataFrame([("a", "undecided"), ("b", "undecided"), ("c", "failed")], "corr_id string, status string")

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({"corr_id": b.corr_id, "status": ["completed" if x == "a" else "nonsense" for x in b.corr_id], "reason": "seen"})

    got = {r.corr_id: r.status for r in telemetry.score_undecided(t, scorer).collect()}
    assert got == {"a": "completed", "b": "undecided", "c": "failed"}
    claims = telemetry.review(t, lambda batches: (pd.DataFrame({"claim_id": b.corr_id, "title": "x"}) for b in batches), "claim_id string, title string")
    assert claims.count() == 3

    def lengths(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [float(len(v))])

    assert telemetry.embed(t, lengths, "status").where("corr_id = 'c'").first().embedding == [6.0]


def test_a_line_is_parsed_once(spark):
    df = spark.createDataFrame([("cloudwatch", "s", 1, '{"level":"error","message":"request timeout"}', None)], sources.RECORD)
    plan = logs.category_clusters(parsing.parse(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") <= 2 and len(plan) < 40_000


def test_transaction_lines_make_no_clusters(spark):
    lines = ["INFO correlationID: c9; Response from Data Services failed with error", "plain error in worker"]
    df = spark.createDataFrame([("cloudwatch", "s", i, x, None) for i, x in enumerate(lines)], sources.RECORD)
    assert [r.n_logs for r in logs.category_clusters(parsing.parse(df)).collect()] == [1]


def test_append_clear_and_fold(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, None), ("b", "x", 2, "OK")], "corr_id string, application string, first_seen_at int, ack_code string")
    path = str(tmp_path / "t")
    tables.append(df, path, "application")
    tables.append(df, path, "application")
    assert spark.read.parquet(path).count() == 4
    tables.clear(df, path)
    assert spark.read.schema(df.schema).parquet(path).count() == 0
    new = spark.createDataFrame([("b", "y", 9, None), ("c", "y", 9, "NO")], df.schema)
    got = {r.corr_id: (r.application, r.first_seen_at, r.ack_code) for r in streaming.fold_updates(df, new).collect()}
    assert got["a"] == ("x", 1, None) and got["b"] == ("x", 2, "OK") and got["c"] == ("y", 9, "NO")


def test_a_timer_fires_on_an_idle_batch_when_the_clock_says_so(spark, tmp_path):
    import time

    schema = "corr_id string, application string, type string, ts_ms long, log_id string, ack_code string"
    spark.createDataFrame([("m1", "xml", "REQUEST", 1000, "l1", None)], schema).write.json(str(tmp_path / "in"))
    (tmp_path / "now").write_text("2000")
    now = str(tmp_path / "now")

    def clock(_: int) -> int:
        with open(now) as f:
            return int(f.read())

    events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    stream = streaming.transactions(events, protocols.XML_APP, frozenset({"OK"}), clock, timeout_ms=1000)
    seen = {}

    def keep(df, batch):
        for r in df.collect():
            seen.setdefault(r.status, batch)

    q = stream.writeStream.outputMode("update").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).start()
    try:
        for wanted in ("awaiting", "error"):
            end = time.time() + 60
            while wanted not in seen and time.time() < end and q.isActive:
                time.sleep(0.2)
            if wanted == "awaiting":
                # By the cluster's time the timer is due; by the clock nothing has happened yet.
                time.sleep(4)
                assert "error" not in seen
                (tmp_path / "now").write_text("9000")
        assert q.exception() is None and seen["error"] > seen["awaiting"]
        rows = [p["numInputRows"] for p in q.recentProgress if p["batchId"] == seen["error"]]
        assert not rows or rows == [0]
    finally:
        q.stop()


def test_label_metrics_take_one_scan(spark):
    c = spark.createDataFrame([(True, True, "a", 1), (False, True, None, 1), (True, False, "b", 2)], "expected boolean, flagged boolean, app string, mode int")
    m = validation.metrics(c, "app", "mode")
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = {(r.by, r.value): (r.tp, r.fp, r.fn) for r in m.collect()}
    assert got == {("all", "all"): (1, 1, 1), ("app", "a"): (1, 0, 0), ("app", None): (0, 1, 0), ("app", "b"): (0, 0, 1), ("mode", "1"): (1, 1, 0), ("mode", "2"): (0, 0, 1)}
    empty = validation.metrics(c.where("false"), "app").collect()
    assert [(r.by, r.accuracy) for r in empty] == [("all", 1.0)]


def test_keyed_state_sends_no_message_that_it_does_not_need():
    """A new transaction reads and writes its state and sets its timer; one that closes lists its timers; a closed one is read only."""
    said = []

    class Handle:
        timers, held = [], None

        def __getattr__(self, name):
            def call(*args):
                said.append(name)
                if name == "get":
                    return self.held
                if name == "update":
                    Handle.held = args[0]
                if name == "registerTimer":
                    Handle.timers = [args[0]]
                return iter(self.timers)

            return call

    class Time:
        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return 10

    machine = streaming._Transactions(protocols.XML_APP.phases, frozenset({"OK", "COMPLETED"}), 100, None)
    machine.handle = machine.state = Handle()
    out = []
    for k, (t, kind, code) in enumerate([(1, "REQUEST", None), (2, "ACK", "bad"), (5, "RESPONSE", "COMPLETED")]):
        row = Row(corr_id="m1", application="xml", type=kind, ts_ms=t, log_id=f"l{t}", ack_code=code)
        out.append([(r.corr_id, r.status, r.waiting_for) for r in machine.handleInputRows(("m1",), iter([row]), Time())])
        said.append(k)
    assert out == [[("m1", "awaiting", "ACK")], [("m1", "failed", None)], []]
    assert said == ["get", "registerTimer", "update", 0, "get", "listTimers", "deleteTimer", "update", 1, "get", 2]


def test_a_protocol_reads_a_tag_once_and_leaves_other_groups_lines(spark):
    xml = "<m><messageType>{}</messageType><messageId>{}</messageId>{}</m>"
    rows = [
        ("/app/payments", xml.format("REQUEST", "m1", "")), ("/app/payments", xml.format("ACK", "a1", "<initMessageId>m1</initMessageId><ackCode>OK</ackCode>")),
        ("/app/payments", xml.format("ACK", "a2", "")), ("/app/calls", "correlationID: c1; Request sent"), ("/app/calls", xml.format("REQUEST", "m2", "")),
        ("/other", '{"type":"response","id":"j1","status":500}'), ("/other", "correlationID: c2; nothing"), ("/other", None),
    ]
    e = protocols.events(spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "log_id string, stream string, raw string"))
    got = {(r.log_id, r.application, r.type, r.corr_id, r.ack_code, r.own_id) for r in e.collect()}
    assert got == {("0", "xml", "REQUEST", "m1", None, "m1"), ("1", "xml", "ACK", "m1", "OK", "a1"), ("3", "calls", "REQUEST", "c1", None, None), ("5", "calls", "RESPONSE", "j1", "500", None)}
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("initMessageId>)") + plan.count("</(?:[\\w.-]+:)?initMessageId>") == 1  # the pattern ends so


def test_transaction_lines_are_left_out_before_they_are_parsed(spark):
    lines = ["INFO correlationID: c9; Response from Data Services failed with error", "plain error in worker"]
    df = spark.createDataFrame([("cloudwatch", "s", i, x, None) for i, x in enumerate(lines)], sources.RECORD)
    rest = logs.unclaimed(df)
    assert rest.columns == df.columns and [r.raw for r in rest.collect()] == lines[1:]
    assert [r.n_logs for r in logs.category_clusters(parsing.parse(rest), claimed=False).collect()] == [1]
    plan = logs.category_clusters(parsing.parse(rest), claimed=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("correlationID") == protocols_named(df) and plan.index("_claimed") > plan.index("message")


def protocols_named(df):
    """How often the plan of one look at a line names the pattern of an id."""
    return logs.unclaimed(df)._jdf.queryExecution().optimizedPlan().toString().count("correlationID")


def test_outcomes_move_numbers_and_no_texts(spark):
    lines = [("1", 1, "INFO correlationID: A; RequestId: 0000000000000000aa"), ("2", 2, "(12345678) X-Correlation-ID=A"), ("3", 3, "(12345678) Method completed with status: 500"), ("4", 4, "correlationID: B")]
    df = spark.createDataFrame(lines, "log_id string, ts_ms long, raw string")
    calls = spark.createDataFrame([("corr:A", "corr:A"), ("req:12345678", "corr:A"), ("req:0000000000000000aa", "corr:A"), ("corr:B", "corr:B")], "id string, call string")
    out = identity.outcomes(df, calls)
    assert {(r.call, r.http_status, r.outcome, r.n_lines) for r in out.collect()} == {("corr:A", 500, "failed", 3), ("corr:B", None, "awaiting", 1)}
    assert sorted(out.collect()) == sorted(identity.http_outcomes(identity.related_lines(df, calls)).collect())
    assert {(r.call, r.log_id) for r in identity.call_lines(df, calls).collect()} == {("corr:A", "1"), ("corr:A", "2"), ("corr:A", "3"), ("corr:B", "4")}
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "first(raw" in plan(identity.related_lines(df, calls)) and "first(raw" not in plan(out) + plan(identity.call_lines(df, calls))
