"""Transaction protocols as data: extractors are column expressions over `raw` (and `fields`)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .parsing import found, once


def _first(raw: Column, pattern: str, group: int = 1) -> Column:
    return found(raw, pattern, group)


def xml_tag(raw: Column, tag: str) -> Column:
    """Inner text of a tag, with or without a namespace prefix."""
    return _first(raw, rf"(?i)<(?:[\w.-]+:)?{tag}>\s*([^<]+?)\s*</(?:[\w.-]+:)?{tag}>")


EVENT = ("type", "corr_id", "ack_code", "own_id")


def _event(kind: Column, corr: Column, ack: Column, own: Column | None = None) -> Column:
    """struct<type, corr_id, ack_code, own_id>, all text; a null type means no event."""
    return F.struct(*[(F.lit(None) if x is None else x).cast("string").alias(n) for n, x in zip(EVENT, (kind, corr, ack, own), strict=True)])


def _read_once(value: Column, read: Callable[[Column], Column]) -> Column:
    """read(value), with the value computed once however often `read` names it; null where the value is null."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), read(v))), F.lit(0))


def xml_event(raw: Column) -> Column:
    """A lambda holds the tags, so each is looked for once, and only where there is a tag at all."""
    names = {"kind": "messageType", "own": "messageId", "init": "initMessageId", "ack": "ackCode"}
    tags = F.struct(*[(F.upper(xml_tag(raw, t)) if n == "kind" else xml_tag(raw, t)).alias(n) for n, t in names.items()])

    def read(t: Column) -> Column:
        corr = F.when(t["kind"] == "REQUEST", t["own"]).when(t["kind"].isin("ACK", "RESPONSE"), t["init"])
        return _event(F.when(corr.isNotNull(), t["kind"]), corr, F.when(corr.isNotNull(), t["ack"]), t["own"])

    return _read_once(F.when(F.contains(raw, F.lit("<")), tags), read)


def call_event(raw: Column) -> Column:
    """The JSON or the text form; a lambda holds the parsed JSON, so a line is parsed once."""
    body = F.ltrim(raw)
    rest = F.regexp_replace(raw, P.HANDLER_TOKEN, "")
    text_type = F.when(rest.rlike(P.jvm(r"(?i)\brequest\b")), "REQUEST").when(rest.rlike(P.jvm(r"(?i)\bresponse\b")), "RESPONSE")
    # The rest of a line is read only where it names an id.
    text = _read_once(_first(raw, P.HANDLER_ID), lambda i: F.struct(i.alias("id"), text_type.alias("type")))
    forms = F.struct(F.when(body.startswith("{"), F.from_json(body, "map<string,string>")).alias("json"), text.alias("text"))

    def read(f: Column) -> Column:
        o, t = f["json"], f["text"]
        json_type = F.upper(F.coalesce(o["messageType"], o["type"]))
        json_id = F.nullif(F.coalesce(o["correlationId"], o["requestId"], o["id"]), F.lit(""))
        is_json = F.coalesce(json_type.isin("REQUEST", "RESPONSE") & json_id.isNotNull(), F.lit(False))
        return _event(
            F.when(is_json, json_type).otherwise(t["type"]), F.when(is_json, json_id).when(t["type"].isNotNull(), t["id"]),
            F.when(is_json, F.coalesce(o["ackCode"], o["status"], o["statusCode"])),
        )

    return _read_once(forms, read)


def gateway_event(raw: Column) -> Column:
    """Execution-log lines keyed by the gateway's own id. Kept for completeness; no protocol uses it."""
    corr = _first(raw, r"(?i)\(([a-z0-9-]{8,})\)")
    status = _first(raw, P.HTTP_STATUS[1])
    kind = F.when(status.isNotNull(), "RESPONSE").when(raw.rlike(P.jvm(r"(?i)\bstarting execution\b")), "REQUEST")
    return _event(F.when(corr.isNotNull(), kind), corr, status)


def xml_success(code: Column) -> Column:
    return code.isNull() | (code == "") | code.rlike(P.XML_OK)


def call_success(code: Column) -> Column:
    c = F.trim(code)
    return code.isNull() | (code == "") | F.when(c.rlike(r"^\d{3}$"), c.try_cast("int") < 400).otherwise(c.rlike(P.CALL_OK))


def http_status(raw: Column) -> Column:
    return F.coalesce(*[_first(raw, p) for p in P.HTTP_STATUS]).cast("int")


def call_ids(raw: Column) -> Column:
    """Namespaced identifiers of an entry: corr:, req:, trace:."""
    one = lambda prefix, p, low: F.transform(F.filter(F.array(_first(raw, p)), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(prefix), F.lower(x) if low else x))
    echoed = F.transform(F.regexp_extract_all(raw, F.lit(P.ID_REQUEST), F.lit(1)), lambda x: F.concat(F.lit("req:"), F.lower(x)))
    return F.array_distinct(F.concat(one("corr:", P.ID_CORR, False), one("req:", P.ID_PAREN, True), echoed, one("req:", P.ID_LEAD, True), one("trace:", P.ID_TRACE, True)))


@dataclass(frozen=True)
class Protocol:
    """One application: its phases, its event extractor and its numeric settings."""

    id: str
    phases: tuple[str, ...]
    event: Callable[[Column], Column]
    success: Callable[[Column], Column]
    groups: tuple[str, ...]
    timeout_minutes: int
    sla_minutes: int
    sla_from: str
    issue_severity: str = "high"
    starts_entry: str | None = None

    @property
    def initial(self) -> str:
        return self.phases[0]

    @property
    def completing(self) -> str:
        return self.phases[-1]


XML_APP = Protocol("xml", ("REQUEST", "ACK", "RESPONSE"), xml_event, xml_success, ("/app/payments*",), 30, 30, "ACK", starts_entry=P.XML_OPENING)
CALL_APP = Protocol("calls", ("REQUEST", "RESPONSE"), call_event, call_success, ("/app/calls*", "/gateway/calls*"), 10, 2, "REQUEST")
INSTALLED = (XML_APP, CALL_APP)


def owner_by_group(stream: Column, apps: tuple[Protocol, ...] = INSTALLED) -> Column:
    """The first application that owns the log group, exactly or by prefix."""
    out = F.lit(None).cast("string")
    for a in reversed(apps):
        for g in reversed(a.groups):
            out = F.when(stream.startswith(g[:-1]) if g.endswith("*") else stream == g, a.id).otherwise(out)
    return out


def events(logs: DataFrame, apps: tuple[Protocol, ...] = INSTALLED) -> DataFrame:
    """Lines that are transaction events: adds application, type, corr_id, ack_code, own_id.

    A line belongs to the application that owns its log group, else to the first whose protocol recognises it. Each
    protocol reads a line once, and none that belongs to another by its group.
    """
    owner = owner_by_group(F.col("stream"), apps)
    made = {f"_event_{a.id}": F.when(owner.isNull() | (owner == a.id), a.event(F.col("raw"))) for a in apps}
    df = once(logs, **made)
    by_content = F.coalesce(*[F.when(F.col(f"_event_{a.id}")["type"].isNotNull(), a.id) for a in apps])
    df = df.withColumn("application", F.coalesce(owner_by_group(F.col("stream"), apps), by_content))
    own = F.coalesce(*[F.when(F.col("application") == a.id, F.col(f"_event_{a.id}")) for a in apps])
    return df.withColumn("_event", own).drop(*made).where(F.col("_event")["type"].isNotNull()).withColumns({name: F.col("_event")[name] for name in EVENT}).drop("_event")


def is_transaction_line(raw: Column, apps: tuple[Protocol, ...] = INSTALLED) -> Column:
    """Whether any protocol recognises the line."""
    out = F.lit(False)
    for a in apps:
        out = out | a.event(raw)["type"].isNotNull()
    return out
