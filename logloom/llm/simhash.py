"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits by a binary trie self-join.

Rows with one fingerprint are one node. Of two fingerprints within 3 bits, at least one of four blocks of 16 bits is equal, so
the join is dealt out by block: in turn r the tries are read with block r first, and below its 16 equal bits a trie is joined with
itself. There, pairs of trie nodes go down together; a pair of nodes that part add a differing bit, and a pair over the
budget is dropped with all that hangs below it. A pair that was equal in an earlier block belongs to that turn and is
dropped too. The budget rises from 1 to 3, and pairs of nodes whose fingerprints are all in one component by then are
not looked at again, so a crowd of near copies costs its links at small distance, not all its pairs.

Tries with more than LARGE fingerprints are first taken apart, four bits at a time: each pair of sub-tries within the budget becomes
a task of its own. A task's frontier is worked off in pieces of a fixed size. Tasks give spanning forests, from
which components are made without collecting them.

Defined results: documents without words (null and empty texts) have fingerprint zero, linked like any other; rows that repeat
a doc_id are linked each by its own text; rows with a null doc_id belong to the component of their text and never name it, so
one that links only with such rows has a null component; extra columns do not matter; an empty table gives an empty result.
Whole texts count, of any length; shingles are hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read
from .graph import components

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Equal blocks by the pigeonhole: one more than the budget.
BLOCKS, BLOCK_BITS = BUDGET + 1, BITS // (BUDGET + 1)
REST_BITS = BITS - BLOCK_BITS
#: Fingerprints that one task joins, and bits by which larger tries are taken apart.
LARGE, SPLIT_BITS = 4096, 4
#: Pairs of trie nodes looked at in one piece, and pairs of fingerprints of two nodes that are compared at once.
PIECE, DIRECT = 1 << 18, 32
#: Shingles hashed in one piece.
HASHED = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half of the hashes of a UTF-8 text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHED):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + HASHED))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["doc_id", "print"])


def turned(prints: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(block `turn`, the other blocks with the earlier turns' first) of unsigned fingerprints."""
    blocks = [(prints >> np.uint64(BITS - BLOCK_BITS * (b + 1))) & np.uint64((1 << BLOCK_BITS) - 1) for b in range(BLOCKS)]
    rest = np.zeros_like(prints)
    for b in range(BLOCKS):
        if b != turn:
            rest = (rest << np.uint64(BLOCK_BITS)) | blocks[b]
    return blocks[turn].astype(np.int64), rest


def _distances(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest position of a component) after the links (a, b)."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def trie_join(keys: np.ndarray, sides: np.ndarray, turn: int, depth: int = 0, spent: int = 0, bits: int = REST_BITS, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) that span the components of keys within the budget. keys: distinct; sides: False or True.

    With both sides, only pairs of one key from each; with one, pairs among them. All keys of a side agree in their first `depth`
    bits, in which the sides differ in `spent` places. Keys equal in an earlier turn's block are left out.
    """
    order = np.lexsort((keys, sides))
    k, n, cut = keys[order], len(keys), int((~sides).sum())
    both = 0 < cut < n
    start = (0, cut, cut, n) if both else (0, n, 0, n)
    labels, links = np.arange(n), []

    def earlier(x: np.ndarray) -> np.ndarray:
        """Whether keys with these differing bits are equal in a block of an earlier turn."""
        out = np.zeros(len(x), bool)
        for b in range(turn):
            out |= (x >> np.uint64(bits - BLOCK_BITS * (b + 1))) & np.uint64((1 << BLOCK_BITS) - 1) == 0
        return out

    def split(lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Where the keys of a node that have the bit of that level begin."""
        bit = np.uint64(1) << (np.uint64(bits - 1) - level.astype(np.uint64))
        low, high = lo.copy(), hi.copy()
        while (open_ := low < high).any():  # binary search in all nodes at once
            mid = (low + high) >> 1
            ones = (k[np.minimum(mid, n - 1)] & bit) != 0
            high = np.where(open_ & ones, mid, high)
            low = np.where(open_ & ~ones, mid + 1, low)
        return low

    for limit in range(max(1, spent), budget + 1):
        # Nodes are ranges of sorted keys; a row has two nodes of one level, the level, and the bits in which they differ.
        stack = [tuple(np.array([x]) for x in (*start, depth, spent))]
        while stack:
            a0, a1, b0, b1, level, err = stack.pop()
            filled = (a0 < a1) & (b0 < b1)
            a0, a1, b0, b1, level, err = (x[filled] for x in (a0, a1, b0, b1, level, err))
            changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
            one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (labels[a0] == labels[b0])
            a0, a1, b0, b1, level, err = (x[~one] for x in (a0, a1, b0, b1, level, err))
            if not len(a0):
                continue
            if len(a0) > PIECE:
                half = len(a0) // 2
                stack += [tuple(x[s] for x in (a0, a1, b0, b1, level, err)) for s in (slice(half), slice(half, None))]
                continue
            small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (level >= bits)
            if small.any():
                s0, s1, t0, t1 = (x[small] for x in (a0, a1, b0, b1))
                wide = t1 - t0
                count = (s1 - s0) * wide
                row = np.repeat(np.arange(len(s0)), count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                i, j = s0[row] + place // wide[row], t0[row] + place % wide[row]
                x = k[i] ^ k[j]
                near = (i != j) & (_distances(x) <= limit) & ~earlier(x) & (labels[i] != labels[j])
                if near.any():
                    i, j = i[near], j[near]
                    links.append((i, j))
                    labels = _joined(labels, i, j)
            a0, a1, b0, b1, level, err = (x[~small] for x in (a0, a1, b0, b1, level, err))
            if not len(a0):
                continue
            am, bm = split(a0, a1, level), split(b0, b1, level)
            same = a0 == b0
            children = [(a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)]
            parts = []
            for number, (p0, p1, q0, q1, add) in enumerate(children):
                take = (err + add <= limit) & ~(same & (number == 3))
                parts.append(tuple(x[take] for x in (p0, p1, q0, q1, level + 1, err + add)))
            stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A forest: every key with the smallest position of its component.
    rest = np.flatnonzero(labels != np.arange(n))
    return order[rest], order[labels[rest]]


TASK = "task long, turn int, depth int, spent int, side boolean, print long, rest long"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint in its four tries."""
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for turn in range(BLOCKS):
            block, rest = turned(own.view(np.uint64), turn)
            n = len(own)
            yield _tasks(np.full(n, turn) << BLOCK_BITS | block, np.full(n, turn), np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool), own, rest.view(np.int64))


def _tasks(task, turn, depth, spent, side, own, rest) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((task, turn, depth, spent, side, own, rest), kinds, strict=True)], names=[f.split()[0] for f in TASK.split(", ")])


def _split(tasks: DataFrame) -> DataFrame:
    """Rows of large tasks, once for each task of two sub-tries within the budget. both: whether a task has two sides."""
    width = 1 << SPLIT_BITS
    child = F.expr(f"cast(shiftrightunsigned(rest, {REST_BITS - SPLIT_BITS} - depth) & {width - 1} as int)")
    rows = tasks.withColumn("own", child).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    add = F.bit_count(F.col("own").bitwiseXOR(F.col("other")))
    rows = rows.withColumn("_spent", (F.col("spent") + add).cast("int")).where(F.col("_spent") <= BUDGET)
    # Within one trie, two sub-tries meet once: the lower is the first side. Of two tries, each keeps its side.
    low = F.when(F.col("both"), F.when(F.col("side"), F.col("other")).otherwise(F.col("own"))).otherwise(F.least("own", "other"))
    high = F.when(F.col("both"), F.when(F.col("side"), F.col("own")).otherwise(F.col("other"))).otherwise(F.greatest("own", "other"))
    side = F.when(F.col("both"), F.col("side")).otherwise(F.col("own") > F.col("other"))
    # A task's number is a hash; two that got the same would only be joined in one.
    return rows.select(F.xxhash64("task", low, high).alias("task"), "turn", (F.col("depth") + SPLIT_BITS).alias("depth"), F.col("_spent").alias("spent"), side.alias("side"), "print", "rest")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of task: links of each task as (a, b) of fingerprints."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        _, turn, depth, spent = key
        sides, prints, rest = (np.concatenate([h[i] for h in held]) for i in range(3))
        a, b = trie_join(rest.view(np.uint64), sides, turn, depth, spent) if len(prints) > 1 else (np.empty(0, int),) * 2
        return pa.RecordBatch.from_arrays([pa.array(prints[x], pa.int64()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        task, turn, depth, spent, side, own, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        bounds = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (spent[1:] != spent[:-1])) + 1).tolist(), len(task)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                continue
            own_key = (int(task[lo]), int(turn[lo]), int(depth[lo]), int(spent[lo]))
            if key != own_key:
                if held:
                    yield done()
                key, held = own_key, []
            held.append((side[lo:hi], own[lo:hi], rest[lo:hi]))
    if held:
        yield done()


def links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (print) within the budget."""
    tasks, ready = prints.select("print").mapInArrow(_turns, TASK), []
    while True:
        tasks = materialize(tasks, "tries")
        sizes = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("_n"), (F.min("side") != F.max("side")).alias("both"), F.max("depth").alias("_depth"), F.max("spent").alias("_spent"))
        over = (F.col("_n") > large) & (F.col("_depth") + SPLIT_BITS <= REST_BITS)
        # Two sides meet in a split task only: a side alone has no partner at that distance.
        alone = ~F.col("both") & (F.col("_spent") > 0) & (F.col("_depth") > 0)
        sizes = materialize(sizes.where((F.col("_n") > 1) & ~alone).select("task", "both", over.alias("over")), "sizes")
        ready.append(tasks.join(sizes.where("not over").select("task"), "task"))
        if sizes.where("over").isEmpty():
            break
        tasks = _split(tasks.join(sizes.where("over").select("task", "both"), "task"))
    rows = ready[0]
    for r in ready[1:]:
        rows = rows.union(r)
    ordered = rows.repartition("task").sortWithinPartitions("task", "turn", "depth", "spent")
    return ordered.mapInArrow(_join, "a long, b long")


def link_documents(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint, component_id."""
    signed = materialize(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, print long"), "prints")
    nodes = materialize(signed.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    labels = materialize(components(materialize(links(nodes, large), "links")), "labels")
    # Nodes without links name themselves. A component's smallest document comes from one row per node.
    reached = nodes.join(labels, nodes["print"] == labels["node"], "left").select("print", "least", "component")
    smallest = reached.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    ids = reached.join(smallest, "component", "left").select("print", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    return signed.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
