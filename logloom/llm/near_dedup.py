"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) text; with fewer words, the
whole sequence is the only shingle. Two documents are linked if their sets' Jaccard similarity is at least
0.75. Documents with equal sets form one class and only its first row goes on, so copies cost one row.

Candidates share a band of 4 of the 128 signature values. In each bucket all members are first compared
with the bucket's smallest class (a star, linear in the bucket). Members still in different components after
that are compared by signature, bucket by bucket, in blocks of a fixed size. Pairs that are alike by signature
are compared once more by their 256 least shingle hashes, which decide sets of that size and sharpen the estimate of larger
ones; what is close enough then is verified best first, in rounds, until none is left between different components. So a
bucket of near copies never emits all its pairs, and no link between components is skipped.

Defined results: documents without words have no shingles, link with nothing and are kept; rows that repeat
a doc_id are versions of one document, which takes the smallest component of its versions; null ids form components of their own and are
kept; an empty table gives an empty result. Extra columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, materialize, read
from .graph import components

SHINGLE = 5
M = 128
ROWS = 4
BANDS = M // ROWS
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
#: Estimates this many standard deviations below the similarity asked for are taken for less than it.
DEVIATIONS = 4
#: Least shingle hashes of a set that go with its signature: the whole set where it has no more.
LEAST = 256
#: Members of a bucket compared in one block, and partners that each has verified in the first round.
BLOCK, FIRST_PAIRS = 2048, 2
#: Links of one document verified in one group.
STAR = 128
#: Up to so many nodes (a few numbers each) go by broadcast to where texts and signatures are read, more by shuffle.
BROADCAST_NODES = 200_000


@dataclass(frozen=True)
class Similar:
    """intersection * 100 >= union * percent."""

    percent: int = 75


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on wrapping unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = w[:n].copy()
    for k in range(1, SHINGLE):
        h = mix64(h + GOLDEN) + w[k : k + n]
    return np.unique(mix64(h))


def super_minhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """(documents, m) signature values. Row d, slot s: the least (round, rank) that an element of d brings to s.

    Every element walks its own permutation of the slots (Fisher-Yates by rounds) and brings the value
    round + random to the slot of the round. All elements go through a round together; those of documents
    whose slots are all filled stop, since later rounds bring larger values only.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    low = np.uint64(0xFFFFFFFF)
    for j in range(m):
        if not len(elements):
            break
        r = mix64(elements + np.uint64((j + 1) * int(GOLDEN) & MASK))
        rows = np.arange(len(elements))
        k = j + ((r & low) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(out, doc * m + slot, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        filled = (out.reshape(-1, m) != np.iinfo(np.uint64).max).all(axis=1)
        if filled.any() and not (live := ~filled[doc]).all():
            elements, doc, perm = elements[live], doc[live], perm[live]
    return out.reshape(-1, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, bands) keys: a hash of a band's number and values."""
    v = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLDEN, v.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h + v[:, :, k] + GOLDEN)
    return h.view(np.int64)


def lowest(share: float, values: int) -> float:
    """The least share of equal values that a pair of the given similarity shows, but for DEVIATIONS."""
    return share - DEVIATIONS * (share * (1 - share) / values) ** 0.5


def may_be_similar(share: float, alike: float, a: np.ndarray, b: np.ndarray, sizes: tuple[int, int]) -> bool:
    """Whether sets with these least hashes (sorted), of which `alike` of the signature agree, may have that similarity."""
    either = np.union1d(a, b)
    whole = max(sizes) <= LEAST
    either = either if whole else either[:LEAST]
    both = np.intersect1d(a, b, assume_unique=True)
    k, n = len(either), int(np.searchsorted(both, either[-1], side="right"))
    if whole:
        return n >= share * k - 1  # equal upper halves of different hashes may be off by one
    return (n + alike * M) / (k + M) >= lowest(share, k + M)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary, least binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: list, hashes: list, sets: list) -> pa.RecordBatch:
        some = [k for k, s in enumerate(sets) if len(s)]
        sig = super_minhash([sets[k] for k in some])
        keys, short = band_keys(sig) if some else np.empty((0, BANDS), np.int64), (sig & np.uint64(0xFFFF)).astype(np.uint16)
        at = {k: i for i, k in enumerate(some)}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(hashes, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([short[at[k]].tobytes() if k in at else None for k in range(len(sets))], pa.binary()),
                pa.array([(s[:LEAST] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                pa.array([keys[at[k]] if k in at else None for k in range(len(sets))], pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_hash", "n_shingles", "set_id", "signature", "least", "bands"],
        )

    ids, hashes, sets, total = [], [], [], 0
    for batch in batches:
        for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append(doc_id)
            hashes.append(text_hash)
            sets.append(shingles(text.as_py()))
            total += len(sets[-1])
            if total >= 60_000 or len(ids) >= 2000:
                yield rows(ids, hashes, sets)
                ids, hashes, sets, total = [], [], [], 0
    if ids:
        yield rows(ids, hashes, sets)


def sign(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_sign, SIGNED)


def _verify_stars(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by (hub, salt, is_member): a hub's text, then its members' texts."""
        key, hub_sets = None, []
        for batch in batches:
            a, b = [], []
            for hub, salt, member, node, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                own = shingles(text.as_py())
                if key != (hub, salt):
                    key, hub_sets = (hub, salt), []
                if not member:
                    hub_sets.append(own)
                    continue
                for other in hub_sets:
                    if min(len(own), len(other)) * 100 < percent * max(len(own), len(other)):
                        continue
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both * 100 >= percent * (len(own) + len(other) - both):
                        a.append(node)
                        b.append(hub)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, written out. b is the star's hub; texts: doc_id (the node), text (binary).

    A hub's members are spread over groups of about STAR; the hub's text goes once to each. Tasks read
    the sorted rows as a stream and hold one hub at a time.
    """
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n"))
    salted = pairs.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / STAR)).cast("int").alias("salt"))
    salted = materialize(salted, "pairs")
    members = salted.join(texts, salted["a"] == texts["doc_id"]).select(F.col("b").alias("hub"), "salt", F.lit(True).alias("member"), F.col("a").alias("node"), "text")
    hubs = salted.select("b", "salt").distinct().join(texts, F.col("b") == texts["doc_id"]).select(F.col("b").alias("hub"), "salt", F.lit(False).alias("member"), F.col("b").alias("node"), "text")
    rows = hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    found = materialize(rows.mapInArrow(_verify_stars(percent), "a long, b long"), "links")
    discard(salted)
    return found


def _foreign_pairs(high: int, percent: int):
    share = percent / 100
    bar = lowest(share, M)

    def pairs_of(band: int, block: list) -> tuple[list, list, bool]:
        """Pairs of a block between different components, and whether there are more. Each member ranks its like
        partners in others; ranks up to high are given now. A pair belongs to the first band that it shares, so
        other buckets leave it out."""
        ids = np.array([r[0] for r in block])
        comp = np.array([r[1] for r in block])
        size = np.array([r[2] for r in block])
        part = np.array([r[3] for r in block])
        sig = np.frombuffer(b"".join(r[4] for r in block), np.uint16).reshape(len(block), M)
        least = [np.unique(np.frombuffer(r[5], "<u4")) for r in block]
        a, b, later = [], [], False
        crossing = len(np.unique(part)) > 1
        for i in range(len(block)):
            near = np.flatnonzero((ids > ids[i]) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i])) & ((part != part[i]) | (not crossing)))
            if not len(near) or (comp[near] == comp[i]).all():
                continue
            equal = sig[near] == sig[i]
            alike = equal.mean(axis=1)
            like = np.flatnonzero((alike >= bar) & (comp[near] != comp[i]))
            like = like[equal[like].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            like = np.array([x for x in like if may_be_similar(share, alike[x], least[i], least[near[x]], (size[i], size[near[x]]))], int)
            ranked = near[like[np.lexsort((ids[near[like]], -alike[like]))]]
            later = later or len(ranked) > high
            for j in ranked[:high]:
                a.append(int(ids[i]))
                b.append(int(ids[j]))
        return a, b, later

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []

        def done() -> pa.RecordBatch:
            a, b, later = pairs_of(key[3], block)
            bucket = [None] * len(a)
            if later:
                a, b, bucket = a + [None], b + [None], bucket + [key[0]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, bucket)], names=["a", "b", "bucket"])

        for batch in batches:
            for bucket, lo, hi, band, *row in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if key != (bucket, lo, hi, band):
                    if len(block) > 1:
                        yield done()
                    key, block = (bucket, lo, hi, band), []
                block.append(row)
        if len(block) > 1:
            yield done()

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Buckets with several components, each row in every block it takes part in: (bucket, lo, hi, ...)."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("_min"), F.max("component").alias("_max"), F.count(F.lit(1)).alias("_n")).where("_min < _max")
    rows = members.join(mixed.select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_c")), "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int"))
    # With one part: the block (0, 0). With more: blocks (p, q) of two parts, and (p, p) for pairs within p.
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return rows.select("bucket", F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi"), "band", "node", "component", "n_shingles", "part")


def link_documents(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    signed = materialize(sign(docs), "signed")
    some = signed.where("doc_id is not null and set_id is not null")
    # A class is a node by the hash of its set, since one document may head several by its versions.
    first = F.min(F.struct(F.col("doc_id").alias("head"), F.col("text_hash").alias("head_hash"))).alias("first")
    classes = materialize(some.groupBy("set_id").agg(first).select("set_id", F.xxhash64("set_id").alias("node"), "first.*"), "classes")
    heads = materialize(
        some.join(classes, (some["set_id"] == classes["set_id"]) & (some["doc_id"] == classes["head"]) & (some["text_hash"] == classes["head_hash"])).select("node", "n_shingles", "signature", "least", "bands").dropDuplicates(["node"]), "heads"
    )
    # Signatures are needed of heads only; what all documents need from here on is small.
    sets = materialize(signed.select("doc_id", "n_shingles", "set_id"), "sets")
    discard(signed)
    keys = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = materialize(keys.join(shared, "bucket"), "members")
    stars = materialize(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    # Only texts of documents in shared buckets are read again.
    wanted = materialize(members.select("node").distinct().join(classes, "node").select("node", "head", "head_hash"), "wanted")
    text = F.col("text").cast("binary")
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash")).join(few(wanted, BROADCAST_NODES), (F.col("doc_id") == F.col("head")) & (F.col("_hash") == F.col("head_hash")))
    texts = materialize(texts.select(F.col("node").alias("doc_id"), "text"), "texts")
    discard(wanted)
    links = verify(stars, texts, similar.percent)
    labels = materialize(components(links), "labels")
    discard(stars)
    high, found, left, rounds = FIRST_PAIRS, [links], members, []
    while True:
        named = (
            left.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            .join(heads.select("node", "n_shingles"), "node").select("bucket", "band", "node", "component", "n_shingles")
        )
        blocks = materialize(_blocks(named), "blocks")
        open_nodes = materialize(blocks.select("node").distinct(), "open")
        some_heads = heads.join(few(open_nodes, BROADCAST_NODES), "node", "left_semi")
        rows = blocks.join(some_heads.select("node", "signature", "least"), "node").select("bucket", "lo", "hi", "band", "node", "component", "n_shingles", "part", "signature", "least")
        ordered = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        got = materialize(ordered.mapInArrow(_foreign_pairs(high, similar.percent), "a long, b long, bucket long"), "pairs")
        discard(blocks, open_nodes)
        rounds.append(got)  # the next round reads it for its buckets
        more = got.where("a is not null").select("a", "b").distinct()
        if not more.isEmpty():
            found.append(verify(more, texts, similar.percent))
            every = found[0]
            for x in found[1:]:
                every = every.union(x)
            before, labels = labels, materialize(components(every), "labels")
            discard(before)
        # Only buckets in which a member has more candidates are looked at again.
        unfinished = got.where("bucket is not null").select("bucket").distinct()
        if unfinished.isEmpty():
            break
        left, high = members.join(unfinished, "bucket"), high * 8
    discard(heads, members, texts, *found, *rounds)
    # What a class reaches holds for all its members; a component goes by the smallest document of its classes.
    smallest = labels.join(classes, "node").groupBy("component").agg(F.min("head").alias("smallest"))
    reached = classes.join(labels.join(smallest, "component"), "node", "left").select("set_id", F.coalesce("smallest", "head").alias("component_id"))
    own = sets.where("doc_id is not null and set_id is not null").select("doc_id", "set_id").join(reached, "set_id").select("doc_id", "component_id").distinct()
    versions = own.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(versions, "doc_id", "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """The rows of docs whose document is kept, each once."""
    verdict = link_documents(docs.select("doc_id", "text"), similar).where("kept and doc_id is not null").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "source", "lang"))
    kept = docs.join(verdict, "doc_id", "left_semi").withColumn("_once", once).where("_once = 1").drop("_once")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
