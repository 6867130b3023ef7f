"""Merkle manifest of a dataset: one tree per group over ordered leaves, a tree over the groups' roots, and proofs.

Trees are kept as a postorder append log. Leaves are numbered within their tree; aligned builders take 2 ** LEVELS consecutive
leaves each and append every node when it is complete, so a segment of the log is the postorder of its subtree.
The segments' last nodes are the leaves of the next round, until one is left per tree. A node's place in the
log follows from the sizes of the subtrees before it (`position`), so a proof reads its siblings by address: those below
a segment's root from the segment itself, the others once per segment from the round above.

Nodes join in twos; a last node without a partner is hashed alone. A tree of one leaf has that leaf as its root.

Defined results: a null field counts as `-`; rows with a null doc_id come first in their tree; rows that repeat a
doc_id follow each other by their leaf, and full copies are leaves of their own; a null group is a group of its own, before the others; extra
columns do not matter; an empty table gives an empty result. A text of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize, read, shuffle_width

#: Levels of a segment, which has 2 ** LEVELS leaves.
LEVELS = 10
NO_SIBLING, LEFT, RIGHT = range(3)


def level_size(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n >> level)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def subtree_size(level: int, index: int, n: int) -> int:
    """Nodes under and with the given one, in a tree of n leaves."""
    return sum(min(level_size(n, k), (index + 1) << (level - k)) - (index << (level - k)) for k in range(level + 1))


def position(level: int, index: int, n: int) -> int:
    """A node's place in the log: s leaves before its subtree have made 2 * s - popcount(s) nodes, and it ends its subtree."""
    before = index << level
    return 2 * before - before.bit_count() + subtree_size(level, index, n) - 1


def _joined(*parts: bytes) -> bytes:
    """sha256 over digests as hexadecimal text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes over the leaves in the order in which they are complete; the last one is `levels` above them."""
    log: list[bytes] = []
    open_nodes: list[tuple[int, bytes]] = []
    for node in leaves:
        level = 0
        log.append(node)
        while open_nodes and open_nodes[-1][0] == level:
            node, level = _joined(open_nodes.pop()[1], node), level + 1
            log.append(node)
        open_nodes.append((level, node))
    while len(open_nodes) > 1 or open_nodes[0][0] < levels:
        level, node = open_nodes.pop()
        partner = open_nodes.pop()[1:] if open_nodes and open_nodes[-1][0] == level else ()
        log.append(_joined(*partner, node))
        open_nodes.append((level + 1, log[-1]))
    return log


def siblings(index: int, n: int, levels: int, log: bytes) -> bytes:
    """Per level a byte for the sibling's side and its digest (zeros for none), read from a segment's log."""
    out = []
    for level in range(levels):
        own = index >> level
        other = own ^ 1
        if other >= level_size(n, level):
            out.append(bytes([NO_SIBLING]) + bytes(32))
        else:
            at = 32 * position(level, other, n)
            out.append(bytes([LEFT if other < own else RIGHT]) + log[at : at + 32])
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    for at in range(0, len(path), 33):
        yield path[at], path[at + 1 : at + 33]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in steps(path):
        leaf = _joined(leaf) if side == NO_SIBLING else _joined(other, leaf) if side == LEFT else _joined(leaf, other)
    return leaf


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows (tree, ...) with idx, the place in its tree, and n, the tree's leaves.

    Range partitions are written once with their number; a tree's counts per partition give the offsets, so a tree of any size is spread.
    """
    spread = rows.repartitionByRange(shuffle_width(rows.sparkSession), "tree", *order).withColumn("_slice", F.spark_partition_id())
    ranged = materialize(spread, "leaves")
    tree = Window.partitionBy("tree")
    counts = ranged.groupBy("tree", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("tree", "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("_slice", "tree").orderBy(*order))
    return ranged.withColumn("_own", own).join(places, ["tree", "_slice"]).withColumn("idx", F.col("_before") + F.col("_own") - 1).drop("_slice", "_own", "_before")


SEGMENT = "tree string, seg long, n long, log binary"


def _build(levels: int):
    def done(key: tuple, leaves: list[bytes]) -> pa.RecordBatch:
        tree, seg, n = key
        log = b"".join(append_log(leaves, min(levels, height(n))))
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.string()), pa.array([seg], pa.int64()), pa.array([n], pa.int64()), pa.array([log], pa.binary())], names=["tree", "seg", "n", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tree, seg, n, leaf) in order: a row per segment with its log."""
        key, leaves = None, []
        for batch in batches:
            for *own, leaf in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != tuple(own):
                    if leaves:
                        yield done(key, leaves)
                    key, leaves = tuple(own), []
                leaves.append(leaf)
        if leaves:
            yield done(key, leaves)

    return run


def build(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of trees over leaves (tree, idx, n, leaf), as segments (tree, seg, n, log) of each round, the lowest first."""
    rounds, span = [], 1 << levels
    while True:
        rows = leaves.select("tree", F.shiftright("idx", levels).alias("seg"), "n", "leaf", "idx")
        ordered = rows.repartition("tree", "seg").sortWithinPartitions("tree", "seg", "idx").drop("idx")
        rounds.append(materialize(ordered.mapInArrow(_build(levels), SEGMENT), "log"))
        over = rounds[-1].where(F.col("n") > span)
        if over.isEmpty():
            return rounds
        leaves = over.select("tree", F.col("seg").alias("idx"), F.ceil(F.col("n") / span).alias("n"), F.substring("log", -32, 32).alias("leaf"))


def log_nodes(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, round, position, digest): every node of each round's log with its place in it."""
    out = None
    for k, segments in enumerate(rounds):
        leaves_before = F.col("seg") * (1 << levels)
        first = 2 * leaves_before - F.bit_count(leaves_before)
        at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("log") / 32).cast("int") - 1), lambda i: F.substring("log", i * 32 + 1, F.lit(32))))
        nodes = segments.select("tree", F.lit(k).alias("round"), first.alias("_first"), at).select("tree", "round", (F.col("_first") + F.col("pos")).alias("position"), F.col("col").alias("digest"))
        out = nodes if out is None else out.union(nodes)
    return out


def roots(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, root): the last node of each tree's last segment."""
    out = None
    for segments in rounds:
        last = segments.where(F.col("n") <= (1 << levels)).select("tree", F.substring("log", -32, 32).alias("root"))
        out = last if out is None else out.union(last)
    return out


PATH = "tree string, idx long, name string, doc_id long, leaf binary, changed binary, path binary, subroot binary, root binary"


def _paths(levels: int):
    span = 1 << levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by (tree, seg, idx): the path above a segment's root (idx -2), its log (idx -1), its leaves."""
        above = log = b""
        subroot = root = None
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for tree, seg, idx, n, name, doc_id, leaf, changed, data, sub, top in zip(*(batch.column(k).to_pylist() for k in range(11)), strict=True):
                if idx == -2:
                    above, subroot, root = data, sub, top
                elif idx == -1:
                    log = data
                else:
                    own = siblings(idx - seg * span, min(span, n - seg * span), min(levels, height(n)), log)
                    for column, x in zip(out, (tree, idx, name, doc_id, leaf, changed, own + above, subroot, root), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (1, 3) else pa.string() if k in (0, 2) else pa.binary()) for k, x in enumerate(out)], names=[f.split()[0] for f in PATH.split(", ")])

    return run


def paths(rounds: list[DataFrame], leaves: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every leaf with the path of its siblings up to the root, from the top round down.

    leaves: tree, idx, n and name, doc_id, leaf, changed to hand on. above: tree, path, subroot, root, the path from each tree's root on.
    """
    none = {"name": "string", "doc_id": "long", "leaf": "binary", "changed": "binary"}
    found, span = None, 1 << levels
    for k in range(len(rounds) - 1, -1, -1):
        single = rounds[k].where(F.col("n") <= span).select("tree", "seg").join(above, "tree").select("tree", "seg", "path", "subroot", "root")
        upper = single if found is None else single.union(found.select("tree", F.col("idx").alias("seg"), "path", "subroot", "root"))
        if k:
            own = rounds[k - 1].where(F.col("n") > span).select("tree", F.col("seg").alias("idx"), F.ceil(F.col("n") / span).alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        else:
            own = leaves
        empty = {c: F.lit(None).cast(t).alias(c) for c, t in (none | {"data": "binary", "subroot": "binary", "root": "binary", "n": "long"}).items()}
        first = upper.select("tree", "seg", F.lit(-2).cast("long").alias("idx"), empty["n"], *[empty[c] for c in none], F.col("path").alias("data"), "subroot", "root")
        second = rounds[k].select("tree", "seg", F.lit(-1).cast("long").alias("idx"), "n", *[empty[c] for c in none], F.col("log").alias("data"), empty["subroot"], empty["root"])
        rest = own.select("tree", F.shiftright("idx", levels).alias("seg"), "idx", "n", *none, empty["data"], empty["subroot"], empty["root"])
        rows = first.union(second).union(rest).repartition("tree", "seg").sortWithinPartitions("tree", "seg", "idx")
        found = rows.mapInArrow(_paths(levels), PATH)
        if k:
            found = materialize(found, "paths")
    return found


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, leaf, changed, path, subroot, root in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            folded = fold(changed, path)
            proof = _joined(*(other for side, other in steps(path) if side != NO_SIBLING)).hex()
            for column, x in zip(out, (doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root), strict=True):
                column.append(x)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in PROVED.split(", ")])


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Binary sha256 over the row's fields with their lengths."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """leaves: tree (string, not null), doc_id, leaf, changed (binary). Every leaf with its proof, checked against `changed`."""
    # One ordering serves the log and the proofs.
    placed = materialize(ranked(leaves, F.asc_nulls_first("doc_id"), "leaf", "changed"), "placed")
    rounds = build(placed, levels)
    subroots = roots(rounds, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    tops = materialize(ranked(subroots, "name"), "subroots")
    top_rounds = build(tops, levels)
    whole = roots(top_rounds, levels)
    start = whole.select("tree", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
    over = paths(top_rounds, tops.withColumns({"doc_id": F.lit(None).cast("long"), "changed": F.col("leaf")}), start, levels)
    over = materialize(over.select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"), "root"), "over")
    found = paths(rounds, placed.withColumn("name", F.lit(None).cast("string")), over, levels)
    return found.select("doc_id", "leaf", "changed", "path", "subroot", "root").mapInArrow(_prove, PROVED)


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree (the language; null first), doc_id, leaf, and changed: the leaf after n_chars is raised in one row of seven."""
    d, s, g, n, t = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    leaf = leaf_hash(d, s, g, n, t)
    changed = F.when(crc_mod(d, 7) == 0, leaf_hash(d, s, g, n + 1, t)).otherwise(leaf)
    tree = F.when(g.isNull(), "").otherwise(F.concat(F.lit("+"), g))
    return docs.select(tree.alias("tree"), d.cast("long").alias("doc_id"), leaf.alias("leaf"), changed.alias("changed"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(read(spark, sf_dir, "documents")))


def _sql_field(c: str) -> str:
    return f"coalesce(concat(strlen({c}::varchar), ':', {c}::varchar), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


#: crc32 of a text of ASCII characters, bit by bit.
SQL_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda c: ascii(c)::bigint)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {SQL_CRC.format("doc_id::varchar")} % 7 = 0 AS touched, {_sql_leaf("(n_chars + 1)")} AS other FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
  SELECT coalesce('+' || lang, '') AS tree, 0 AS lvl, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 2, n
), subs AS (
  SELECT tree, h, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, idx, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n
), way AS (
  SELECT 'l' || tree AS tree, lvl, idx, h, n FROM up UNION ALL SELECT 't', lvl, idx, h, n FROM top
), fold AS (
  SELECT p.doc_id, p.leaf, 'l' || s.tree AS tree, s.idx AS top_idx, 0 AS lvl, p.idx, CASE WHEN touched THEN other ELSE leaf END AS h, '' AS proof
  FROM placed p JOIN subs s ON s.tree = coalesce('+' || p.lang, '')
  UNION ALL
  SELECT f.doc_id, f.leaf, CASE WHEN o.n = 1 THEN 't' ELSE f.tree END, f.top_idx, CASE WHEN o.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN o.n = 1 THEN f.top_idx ELSE f.idx // 2 END,
    CASE WHEN o.n = 1 THEN f.h WHEN b.h IS NULL THEN sha256(f.h) WHEN b.idx < f.idx THEN sha256(b.h || f.h) ELSE sha256(f.h || b.h) END, f.proof || CASE WHEN o.n = 1 THEN '' ELSE coalesce(b.h, '') END
  FROM fold f JOIN way o ON o.tree = f.tree AND o.lvl = f.lvl AND o.idx = f.idx LEFT JOIN way b ON b.tree = f.tree AND b.lvl = f.lvl AND b.idx = xor(f.idx, 1)
  WHERE NOT (f.tree = 't' AND o.n = 1)
)
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM fold f JOIN (SELECT max(lvl) AS lvl, max_by(h, lvl) AS h FROM top) r ON f.tree = 't' AND f.lvl = r.lvl JOIN subs s ON s.idx = f.top_idx
"""
