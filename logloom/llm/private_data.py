"""Personal data: patterns, then information-theoretic sanitisation (native: DataFrame functions only).

E-mail addresses, IPv4 addresses, card and phone numbers are found by fixed patterns (the base). Their values
are the protected entities. A term (a run of letters and digits) that occurs with an entity,
anywhere in a text, may reveal it: from corpus counts, the disclosure of
entity e by term t is PMI(t; e) / IC(e), the share of e's information (-log p(e)) that t gives away; 1 means
that t occurs with e only. Terms over the threshold are removed from all documents that hold e, as further
spans; base spans stay. Only pairs seen in at least `contexts` different surroundings count, so copies of
one document prove nothing, and only entities of that many documents can have such pairs.

Defined results: a null text counts as empty and has no spans; rows with equal doc_id and text are one
document in all counts and get equal results; offsets are code points, ends exclusive; an empty table gives an
empty result; extra columns are ignored by `find` and kept by `sanitise`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

#: The patterns, written so that a search takes linear time: a match starts at a run's beginning or where the
#: last match ended, and repeated groups are possessive (nothing follows them).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters on each side of an entity that make its surroundings.
REACH = 120
#: What parts terms.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Up to so many candidate terms (or pairs) go by broadcast, more by shuffle.
SMALL = 20_000


@dataclass(frozen=True)
class Disclosure:
    threshold: float = 0.8
    contexts: int = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: _valid(kind, s["value"])


def _positions(text: Column, pattern: Column) -> Column:
    """array<struct<start, stop, value>> of all matches: the parts between them give the places."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        begin = a["at"] + F.length(z["part"])
        end = begin + F.length(z["found"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"), z["found"].alias("value")))).alias("out"))

    parts = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.aggregate(F.arrays_zip(parts.alias("part"), found.alias("found")), start, step)["out"]).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))


def _spans_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))


def _terms(text: Column) -> Column:
    """Distinct terms of a text, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN)), "")


def _surroundings(text: Column, span: Column) -> Column:
    """Hash of the characters around a span."""
    first = F.greatest(span["start"] - REACH, F.lit(0))
    return F.xxhash64(F.substring(text, first + 1, span["start"] - first), F.substring(text, span["stop"] + 1, F.lit(REACH)))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans by kind (valid only) and entities: array<struct<entity, context>>."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    for kind, pattern in PATTERNS.items():
        raw = _positions(F.col("text"), F.lit(pattern))
        if kind == "email":  # most texts have no @ and need no search
            raw = F.when(F.contains("text", F.lit("@")), raw).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))
        rows = rows.withColumn(f"_{kind}", raw).withColumn(kind, F.filter(f"_{kind}", _valid_span(kind))).drop(f"_{kind}")
    entity = {"email": lambda v: F.lower(v), "ip": lambda v: v, "card": _digits, "phone": _digits}

    def entities(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(F.concat(F.lit(k + ":"), entity[k](s["value"])).alias("entity"), _surroundings(F.col("text"), s).alias("context")))

    all_of_them = F.concat(*[entities(k) for k in PATTERNS])
    bare = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k)
    return rows.select("doc_id", "text_hash", *[bare(k) for k in PATTERNS], all_of_them.alias("entities"))


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its size is checked to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def revealing_terms(found: DataFrame, docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """(entity, term): terms that disclose an entity beyond the threshold. found: materialized result of `find`."""
    seen = found.select("doc_id", "text_hash", F.explode("entities").alias("x")).select("doc_id", "text_hash", "x.*")
    holders = seen.select("entity", "doc_id", "text_hash").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= rule.contexts)
    holders = materialize(holders, "entities")
    held = materialize(seen.join(_few(holders), "entity").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "entity", "n_entity", "context").distinct(), "held")
    keys = held.select("_d", "_h").distinct()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    # Terms of the whole texts that hold these entities, each text once.
    bags = texts.join(_few(keys), same).select("doc_id", "text_hash", _terms(F.col("text")).alias("bag")).dropDuplicates(["doc_id", "text_hash"])
    bags = materialize(bags, "bags")
    both = bags.join(held, same).select("entity", "n_entity", "doc_id", "text_hash", "context", F.explode("bag").alias("term"))
    pairs = both.groupBy("entity", "n_entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("doc_id", "text_hash").alias("n_both")).where(F.col("contexts") >= rule.contexts)
    # A term occurs in at least as many documents as hold it and an entity. Where even that number is too large
    # for the threshold, the term cannot reveal the entity, so common words need no count over the corpus.
    total = float(docs.count())
    among = bags.select(F.explode("bag").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_among"))
    most = F.col("n_both") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1.0 - rule.threshold)) * (1 + 1e-9)
    pairs = materialize(pairs.join(among, "term").where(F.col("n_among") <= most).drop("n_among"), "pairs")
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("entity", "term")
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    # counted before the join: tasks send one row per word they met, however common
    spread = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(_few(terms), "term", "left_semi")
    pmi = F.log(F.col("n_both") * F.lit(total) / (F.greatest("n_term", "n_both") * F.col("n_entity")))
    information = F.log(F.lit(total) / F.col("n_entity"))
    return pairs.join(spread, "term").where((information > 0) & (pmi / information >= rule.threshold)).select("entity", "term")


def term_spans(found: DataFrame, docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): places of revealing terms in the documents that hold their entity."""
    held = found.select("doc_id", "text_hash", F.explode("entities.entity").alias("entity")).distinct()
    wanted = held.join(_few(revealing), "entity").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    wanted = _few(materialize(wanted, "wanted"))
    hit = texts.join(wanted.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_hash", "_h"), (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    places = F.flatten(F.transform("terms", lambda t: _positions(F.col("text"), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), t, F.lit(r"(?![\p{L}\p{N}])")))))
    bare = F.array_sort(F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    return hit.select("_d", "_h", bare.alias("terms")).dropDuplicates(["_d", "_h"])


def all_spans(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, spans by kind, and `terms` (outside the base spans)."""
    found = materialize(find(docs), "found")
    revealing = materialize(revealing_terms(found, docs, rule), "revealing")
    terms = term_spans(found, docs, revealing)
    joined = found.drop("entities").join(terms, (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    base = F.concat(*PATTERNS)
    apart = lambda t: ~F.exists(base, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select("doc_id", "text_hash", *PATTERNS, F.coalesce(F.filter("terms", apart), none).alias("terms"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets."""
    spans = all_spans(docs.select("doc_id", "text"), rule).dropDuplicates(["doc_id", "text_hash"])
    kinds = [*PATTERNS, "terms"]

    def tag(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"[{k.upper().rstrip('S')}]").alias("tag")))

    tagged = F.array_sort(F.concat(*[tag(k) for k in kinds]))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), s["tag"])
        inside = s["start"] < a["at"]  # overlaps a span of another kind: that one already stands for it
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(inside, a["out"]).otherwise(cut).alias("out"))

    tags = spans.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), tagged.alias("_tags"))
    rows = docs.withColumn("_hash", F.xxhash64(body)).join(tags, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    done = F.aggregate("_tags", start, step)
    text = F.when(F.col("text").isNotNull(), F.concat(done["out"], F.substring(body, done["at"] + 1, F.length(body))))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op6_private_data(spark, sf_dir: str) -> DataFrame:
    spans = all_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_spans_text(k, F.col(k)) for k in PATTERNS])
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _spans_text("term", F.col("terms"))), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )
