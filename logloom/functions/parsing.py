"""Raw line -> structured record, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

STRINGS = "map<string,string>"


def last_wins(keys: Column, values: Column) -> Column:
    """map of keys to values where the last of equal keys counts, whatever the session's policy."""
    back = F.reverse(keys)
    last = lambda e, i: i == F.size(keys) - F.array_position(back, e["k"]).cast("int")
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), last))


def merged(*maps: Column) -> Column:
    """Union of maps; later ones win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, _absent_from(m)), m)
    return out


def _absent_from(m: Column):
    return lambda k, _: ~F.map_contains_key(m, k)


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def template(message: Column) -> Column:
    for pattern, mask in P.MASKS:
        message = F.regexp_replace(message, P.jvm(pattern), mask)
    return F.trim(message)


def fingerprint(message: Column) -> Column:
    return F.substring(F.sha1(template(message)), 1, 16)


def detect_level(raw: Column, explicit: Column) -> Column:
    found = F.when(F.lower(explicit).isin(*P.LEVELS[:6]), F.lower(explicit))
    for level, pattern in P.LEVEL_WORDS:
        found = found.when(raw.rlike(P.jvm(pattern)), level)
    return found.otherwise("unknown")


def entities(raw: Column) -> Column:
    """map<string, array<string>> of the entity kinds that occur, with distinct values."""
    pairs = [F.struct(F.lit(name).alias("key"), F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(P.jvm(p)), F.lit(g)), lambda x: F.trim(x))).alias("value")) for name, (p, g) in P.ENTITIES.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.size(e["value"]) > 0))


def found(text: Column, pattern: str, group: int) -> Column:
    """What a group matches; null for nothing. A lambda holds it: F.nullif would look for the pattern twice."""
    return F.get(F.transform(F.array(F.regexp_extract(text, P.jvm(pattern), group)), lambda v: F.when(v != "", v)), F.lit(0))


def numbers(raw: Column) -> dict[str, Column]:
    """latency_ms, bytes and status_code; null where the text has none."""
    first = lambda p, g: found(raw, p, g)
    latency = first(P.LATENCY, 1).try_cast("double") * F.when(F.lower(first(P.LATENCY, 2)) == "s", 1000).otherwise(1)
    return {"latency_ms": latency, "bytes": first(P.BYTES, 1).try_cast("long"), "status_code": first(P.STATUS, 1).try_cast("int")}


def _number_text(x: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, whatever is filtered or selected later.

    A one-element array is exploded: filters and projections on its outcome are not merged into the expressions.
    """
    made = F.struct(*[v.alias(k) for k, v in columns.items()])
    rows = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(made)).alias("_made"))
    return rows.select(*[c for c in rows.columns if c != "_made"], *[F.col("_made")[k].alias(k) for k in columns])


def parse(records: DataFrame) -> DataFrame:
    """Add log_id (if absent), level, message, fields, entities, latency_ms, bytes, status_code, template, fingerprint.

    records: source, stream, ts_ms, raw and, optionally, attributes (map). Text that starts like JSON but is not,
    and logfmt with fewer than two pairs, count as free text.
    """
    trimmed = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    attributes = F.coalesce(F.col("attributes"), _empty()) if "attributes" in records.columns else _empty()
    df = records.withColumn("_t", trimmed)
    df = df.withColumn("_json", F.when(F.col("_t").startswith("{"), F.from_json("_t", STRINGS)))
    df = df.withColumn("_keys", F.regexp_extract_all("_t", F.lit(P.KEY_VALUE), F.lit(1))).withColumn("_values", F.transform(F.regexp_extract_all("_t", F.lit(P.KEY_VALUE), F.lit(2)), lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", "")))
    df = df.withColumn("_kv", F.when(F.col("_json").isNull() & (F.size("_keys") >= 2), last_wins(F.col("_keys"), F.col("_values"))))
    j, k = F.col("_json"), F.col("_kv")
    message = F.coalesce(j["message"], j["msg"], j["log"], k["msg"], k["message"], F.col("_t"))
    df = once(df, _json=j, _kv=k, message=message, level=detect_level(F.col("raw"), F.coalesce(j["level"], j["severity"], k["level"])), **numbers(F.col("raw")))
    names = {"latencyMs": _number_text(F.col("latency_ms")), "bytes": F.col("bytes").cast("string"), "statusCode": F.col("status_code").cast("string")}
    numeric = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in names.items()]), lambda e: e["value"].isNotNull()))
    df = df.withColumn("fields", merged(F.coalesce(j, k, _empty()), numeric, attributes)).withColumn("entities", entities(F.col("raw")))
    df = df.withColumn("template", template(F.col("message"))).withColumn("fingerprint", F.substring(F.sha1("template"), 1, 16))
    if "log_id" not in records.columns:
        df = df.withColumn("log_id", F.sha2(F.concat_ws("\x1f", "source", "stream", F.col("ts_ms").cast("string"), "raw"), 256))
    return df.drop("_t", "_json", "_keys", "_values", "_kv")


def category() -> Column:
    """Anomaly category of a parsed line; null for normal traffic."""
    status, latency = F.coalesce("status_code", F.lit(0)), F.coalesce("latency_ms", F.lit(0.0))
    found = (
        F.when(status.between(500, 599), "http_5xx").when(status.isin(401, 403), "auth").when(status == 429, "rate_limit")
        .when(status.between(400, 499), "http_4xx").when(latency >= P.LATENCY_THRESHOLD_MS, "latency")
    )
    for name, pattern in P.CATEGORIES:
        found = found.when(F.col("message").rlike(P.jvm(pattern)), name)
    return found.when(F.col("level").isin("error", "fatal"), "exception")


def redact_secrets(text: Column) -> Column:
    for pattern, mask in P.SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def has_private_key(text: Column) -> Column:
    return text.rlike(P.PRIVATE_KEY)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9-]+", "-"), r"^-|-$", "")


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def humanised_minutes(m: Column) -> Column:
    """Minutes as days, hours or minutes, the largest unit that divides evenly."""
    return F.when(m % 1440 == 0, F.concat((m / 1440).cast("long"), F.lit(" days"))).when(m % 60 == 0, F.concat((m / 60).cast("long"), F.lit(" hours"))).otherwise(F.concat(m, F.lit(" minutes")))
