"""Language-model scoring: a causal self-attention model on subword ids, next to a smoothed word unigram.

The unigram (base) counts the lower-cased words of all training documents. The TOP most frequent words go to
all tasks (a fixed number); the rest are joined by shuffle, where no word can hold more than one TOP-th of
all tokens, so no key is hot.

The model predicts each subword from the subwords before it: one attention head over the last positions of a
window, added to a vector of the last subword, gives the state; the next subword's class, then its place in
the class, are two softmaxes on the state. Subwords beyond the most frequent ones share one place, and in it each has
its own share, by its count; as inputs they have vectors by a hash. All counts are of all training documents: those of
single subwords are the biases, those of pairs give the vectors of last subwords and of outputs their start (a
truncated singular value decomposition of the pairs' mutual information). Then all parameters are
trained by numpy (Adam) on every window of every training document. Trainers each hold a bounded part of the
windows; each round takes another part of them all, and after it the trainers' parameters are averaged.

Scoring cuts a document into windows whose targets do not overlap but whose contexts do: each window repeats
the CONTEXT inputs before its first target, so every subword is scored once, with at least that context, by
batched masked attention. Texts, their subword ids and row numbers are written once and read by all steps.

Defined results: a null text is empty and is scored as its end alone; without training documents counts are 0
and the model is uniform; repeated rows count and score as documents of their own; rows with a null doc_id
have the crc32 of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialize, read
from .packing import subwords, vocabulary_path

CLASSES, MEMBERS, DIM = 64, 32, 16
SLOTS = CLASSES * MEMBERS
START, END, OTHER, FIRST = 0, 1, 2, 3
CONTEXT, STRIDE = 6, 26
WINDOW = CONTEXT + STRIDE
#: Frequent words that all tasks hold.
TOP = 200_000
#: Places by hash for the inputs that have none of their own.
HASHED = 1024
#: Windows of a trainer; rounds of training and averaging; batches that a trainer takes in a round at least, by more passes where windows are few.
TRAINER, ROUNDS, STEPS, BATCH, RATE = 100_000, 2, 150, 256, 0.01


# ---- the model -------------------------------------------------------------------------------------------------

SHAPES = {
    "embed": (SLOTS + HASHED, DIM), "place": (WINDOW, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, DIM), "last": (SLOTS + HASHED, DIM),
    "to_class": (CLASSES, DIM), "class_bias": (CLASSES,), "to_member": (SLOTS, DIM), "member_bias": (SLOTS,),
}
MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 0.0, -1e9).astype(np.float32)


def initial(frequency: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters whose state-free part is the given frequency of the slots."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    f = (frequency + 0.5).reshape(CLASSES, MEMBERS)
    p["class_bias"] = np.log(f.sum(axis=1) / f.sum()).astype(np.float32)
    p["member_bias"] = np.log(f / f.sum(axis=1, keepdims=True)).astype(np.float32).reshape(-1)
    return p


def informed(p: dict[str, np.ndarray], pairs: np.ndarray, seed: int = 4) -> dict[str, np.ndarray]:
    """Parameters whose last-subword and output vectors start at the main directions of what pairs[last, next] tell.

    The table of log P(next | last) / P(next), shrunk where counts are small and weighted by the frequencies of both,
    is decomposed by randomised subspace iteration.
    """
    n = pairs + 20.0 * pairs.sum(axis=1, keepdims=True).clip(1e-9) / pairs.sum().clip(1e-9) * pairs.sum(axis=0) / pairs.sum(axis=1, keepdims=True).clip(1e-9)
    row, col = n.sum(axis=1, keepdims=True), n.sum(axis=0, keepdims=True)
    told = np.where((row > 0) & (col > 0), np.log(np.maximum(n, 1e-9) * n.sum() / np.maximum(row * col, 1e-9)), 0.0)
    r, c = np.sqrt(row / n.sum()), np.sqrt(col / n.sum())
    table = (np.clip(told, -4, 8) * r * c).astype(np.float32)
    q = np.random.default_rng(seed).normal(size=(len(pairs), DIM + 8)).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(table @ (table.T @ q))[0]
    u, size, v = np.linalg.svd(q.T @ table, full_matrices=False)
    u, size, v = (q @ u)[:, :DIM], np.sqrt(size[:DIM]), v[:DIM]
    start, to_next = u * size / np.maximum(r, 1e-4), (v * size[:, None]).T / np.maximum(c.T, 1e-4)
    weight = col.reshape(CLASSES, MEMBERS, 1) + 1e-9
    grouped = to_next.reshape(CLASSES, MEMBERS, DIM)
    centre = (grouped * weight).sum(axis=1) / weight.sum(axis=1)
    out = dict(p)
    out["last"] = p["last"] * 0.1
    out["last"][:SLOTS] += start
    out["to_class"], out["to_member"] = centre.astype(np.float32), (grouped - centre[:, None]).reshape(-1, DIM).astype(np.float32)
    return {k: np.ascontiguousarray(x, np.float32) for k, x in out.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def _tables(p: dict[str, np.ndarray]) -> tuple:
    scale = np.float32(1 / math.sqrt(DIM))
    return (
        p["embed"] @ p["query"] * scale, p["place"][CONTEXT:] @ p["query"] * scale, p["embed"] @ p["key"], p["place"] @ p["key"],
        p["embed"] @ p["value"], p["place"] @ p["value"], p["last"],
    )


def _attend(tables: tuple, x: np.ndarray) -> tuple:
    """x: (windows, WINDOW) inputs. Queries, keys, values, attention weights and states of the targets' positions."""
    tq, pq, tk, pk, tv, pv, last = tables
    q, k, v = tq[x[:, CONTEXT:]] + pq, tk[x] + pk, tv[x] + pv
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -50, 50, out=a)  # neither overflow nor denormal numbers
    a += MASK
    np.exp(a, out=a)
    total = a.sum(axis=2, keepdims=True)
    h = a @ v
    h /= total
    h += last[x[:, CONTEXT:]]
    return q, k, v, a, total, h


def _grouped(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of targets by class and the bounds of the classes in it."""
    c = (y // MEMBERS).astype(np.uint8)
    return np.argsort(c, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(c, minlength=CLASSES))])


def log_probability(p: dict[str, np.ndarray], tables: tuple, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Natural log probability of the valid targets, in order."""
    h = _attend(tables, x)[-1].reshape(-1, DIM)[valid]
    y = y.reshape(-1)[valid]
    z = h @ p["to_class"].T
    z += p["class_bias"]
    out = z[np.arange(len(y)), y // MEMBERS]
    np.clip(z, -60, 80, out=z)
    out = out - np.log(np.exp(z, out=z).sum(axis=1))
    order, bounds = _grouped(y)
    hs, ys, inner = h[order], y[order] % MEMBERS, np.empty(len(y), np.float32)
    weights, bias = p["to_member"].reshape(CLASSES, MEMBERS, DIM), p["member_bias"].reshape(CLASSES, MEMBERS)
    for c in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[c], bounds[c + 1]
        z = hs[a:b] @ weights[c].T
        z += bias[c]
        own = z[np.arange(b - a), ys[a:b]]
        np.clip(z, -60, 80, out=z)
        inner[a:b] = own - np.log(np.exp(z, out=z).sum(axis=1))
    out[order] += inner
    return out


def _summed(rows: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the vectors x by row number."""
    places = (at.reshape(-1, 1).astype(np.int64) * DIM + np.arange(DIM)).reshape(-1)
    return np.bincount(places, x.reshape(-1), minlength=rows * DIM).reshape(rows, DIM)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log probability of the valid targets."""
    g = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    q, k, v, a, total, h = _attend(_tables(p), x)
    a /= total
    n = max(int(valid.sum()), 1)
    hv, yv = h.reshape(-1, DIM)[valid], y.reshape(-1)[valid]
    z = hv @ p["to_class"].T
    z += p["class_bias"]
    np.clip(z, -60, 80, out=z)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(yv)), yv // MEMBERS] -= 1
    z /= n
    g["to_class"], g["class_bias"] = z.T @ hv, z.sum(axis=0)
    dh_valid = z @ p["to_class"]
    order, bounds = _grouped(yv)
    weights, bias = p["to_member"].reshape(CLASSES, MEMBERS, DIM), p["member_bias"].reshape(CLASSES, MEMBERS)
    gw, gb = g["to_member"].reshape(CLASSES, MEMBERS, DIM), g["member_bias"].reshape(CLASSES, MEMBERS)
    for c in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[c] : bounds[c + 1]]
        z = hv[rows] @ weights[c].T
        z += bias[c]
        np.clip(z, -60, 80, out=z)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(rows)), yv[rows] % MEMBERS] -= 1
        z /= n
        gw[c], gb[c] = z.T @ hv[rows], z.sum(axis=0)
        dh_valid[rows] += z @ weights[c]
    dh = np.zeros((x.shape[0] * STRIDE, DIM), np.float32)
    dh[valid] = dh_valid
    dh = dh.reshape(-1, STRIDE, DIM)
    g["last"] = _summed(len(g["last"]), x[:, CONTEXT:], dh)
    da = dh @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
    e = p["embed"][x] + p["place"]
    scale = np.float32(1 / math.sqrt(DIM))
    both = (-1, DIM)
    g["query"] = e[:, CONTEXT:].reshape(both).T @ dq.reshape(both) * scale
    g["key"], g["value"] = e.reshape(both).T @ dk.reshape(both), e.reshape(both).T @ dv.reshape(both)
    de = dk @ p["key"].T + dv @ p["value"].T
    de[:, CONTEXT:] += dq @ p["query"].T * scale
    g["embed"] = _summed(len(g["embed"]), x, de)
    g["place"] = de.sum(axis=0)
    return g


def windows_of(slots: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW) and targets (n, STRIDE; START where there is none) of a document's slots; seen: the slots as inputs."""
    seen = slots if seen is None else seen
    n = -(-len(slots) // STRIDE)
    inputs = np.full(CONTEXT + n * STRIDE, START, np.int32)
    inputs[CONTEXT + 1 : CONTEXT + len(slots)] = seen[:-1]
    targets = np.full(n * STRIDE, START, np.int32)
    targets[: len(slots)] = slots
    return np.lib.stride_tricks.sliding_window_view(inputs, WINDOW)[::STRIDE], targets.reshape(n, STRIDE)


def _windows(ids: np.ndarray, slots: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a document's subword ids and its end."""
    return windows_of(np.append(slots[ids], np.int32(END)), np.append(seen[ids], np.int32(END)))


def train_part(params: np.ndarray, windows: np.ndarray, seed: int) -> np.ndarray:
    """Adam over one trainer's windows, (n, WINDOW + STRIDE): inputs, then targets. One pass, or more up to STEPS batches."""
    p = shaped(params.copy())
    m, s = ({k: np.zeros(v, np.float32) for k, v in SHAPES.items()} for _ in range(2))
    rng, t = np.random.default_rng(seed), 0
    for _ in range(max(1, -(-STEPS // -(-len(windows) // BATCH)))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            w = windows[order[at : at + BATCH]]
            x, y = w[:, :WINDOW], w[:, WINDOW:]
            g, t = gradients(p, x, y, y.reshape(-1) != START), t + 1
            rate = RATE * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k in SHAPES:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] * g[k] - s[k])
                p[k] -= rate * m[k] / (np.sqrt(s[k]) + 1e-8)
    return flat(p)


# ---- fitting on Spark ------------------------------------------------------------------------------------------


ROWS = "row long, doc_id long, train boolean, text binary"


def _tokenized(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = subwords(path or vocabulary_path())
        for b in batches:
            ids = [ids for _, ids in known.each(t.as_py() for t in b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=["row", "doc_id", "train", "text", "ids"])

    return run


def numbered(docs: DataFrame, train: Column, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) with a row number, `train`, the text lower-cased (binary) and its subword ids (32 bits each), written once."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), lower.alias("text"))
    return materialize(rows.mapInArrow(_tokenized(path), ROWS + ", ids binary"), "lm-rows")


def _count_ids(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords.cache_clear()  # the worker tokenises no more
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return run


def _count_pairs(slots: np.ndarray):
    """How often a slot follows another (START before the first), as rows (last * SLOTS + next, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * SLOTS, np.int64)
        for b in batches:
            for at in range(0, len(b), 2000):
                texts = [x.as_py() for x in b.column(0)[at : at + 2000]]
                ids = slots[np.frombuffer(b"".join(texts), "<u4")]
                sizes = np.array([len(x) // 4 for x in texts])
                following = np.insert(ids, np.cumsum(sizes), END)
                ends = np.cumsum(sizes + 1) - 1
                last = np.concatenate([[START], following[:-1]])
                last[ends[:-1] + 1] = START
                total += np.bincount(last.astype(np.int64) * SLOTS + following, minlength=SLOTS * SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    return run


def slot_table(ids: list[int], size: int) -> np.ndarray:
    """Subword id -> slot. ids: the kept ids, most frequent first."""
    table = np.full(size, OTHER, np.int32)
    table[np.array(ids, np.int64)] = np.arange(FIRST, FIRST + len(ids), dtype=np.int32)
    return table


def seen_table(slots: np.ndarray) -> np.ndarray:
    """Subword id -> slot as an input: those without a place of their own are told apart by a hash."""
    return np.where(slots == OTHER, SLOTS + np.arange(len(slots)) % HASHED, slots).astype(np.int32)


def vocabulary_size(path: str | None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary_path()).get_vocab_size(with_added_tokens=True)


def _mean(parts: pd.DataFrame) -> tuple[np.ndarray, int]:
    n = parts["n"].to_numpy()
    return np.sum([np.frombuffer(p, np.float32) * (w / n.sum()) for p, w in zip(parts["params"], n, strict=True)], axis=0).astype(np.float32), int(n.sum())


def _average(parts: DataFrame) -> np.ndarray | None:
    """Weighted mean of parameter rows (node, n, params), in a tree of 32 children."""
    while (count := parts.count()) > 32:
        def merge(df: pd.DataFrame) -> pd.DataFrame:
            mean, n = _mean(df)
            return pd.DataFrame({"node": [int(df["node"].iloc[0]) // 32], "n": [n], "params": [mean.tobytes()]})

        parts = materialize(parts.groupBy(F.floor(F.col("node") / 32)).applyInPandas(merge, "node long, n long, params binary"), "averages")
    return _mean(parts.toPandas())[0] if count else None


def _trainer(turn: int, shared):
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(sorted(part["window"])), "<u2").reshape(len(part), -1).astype(np.int32)
        node = int(part["node"].iloc[0])
        return pd.DataFrame({"node": [node], "n": [len(w)], "params": [train_part(shared.value, w, turn * 1_000_003 + node).tobytes()]})

    return learn


def fit(rows: DataFrame, path: str | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
    """(parameters, slot table, log share of each subword in OTHER). rows: training rows of `numbered`."""
    size = vocabulary_size(path)
    counts = np.zeros(size)
    for r in rows.select("ids").mapInArrow(_count_ids(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    kept = [int(i) for i in np.lexsort((np.arange(size), -counts))[: SLOTS - FIRST] if counts[i]]
    slots = slot_table(kept, size)
    others = np.where(slots == OTHER, counts + 1.0, 0.0)
    share = np.where(others > 0, np.log(np.maximum(others, 1.0) / max(others.sum(), 1.0)), 0.0)
    frequency = np.zeros(SLOTS)
    frequency[FIRST : FIRST + len(kept)] = counts[kept]
    frequency[OTHER] = others.sum() - (others > 0).sum()
    frequency[END] = rows.count()
    pairs = np.zeros(SLOTS * SLOTS)
    counted = rows.select("ids").mapInArrow(_count_pairs(slots), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS * SLOTS rows of two numbers
    pairs[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    params = initial(frequency)
    if len(counted):
        params = informed(params, pairs.reshape(SLOTS, SLOTS))
    params = flat(params)
    seen = seen_table(slots)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out = [], []

        def done() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["row", "window"])
            keys.clear(), out.clear()
            return got

        for b in batches:
            for row, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                both = np.concatenate(_windows(np.frombuffer(ids.as_py(), "<u4"), slots, seen), axis=1).astype("<u2")
                keys += [row] * len(both)
                out += [w.tobytes() for w in both]
                if len(out) > 20_000:
                    yield done()
        yield done()

    windows = materialize(rows.select("row", "ids").mapInArrow(cut, "row long, window binary"), "lm-windows")
    trainers = max(1, -(-windows.count() // TRAINER))
    place = F.pmod(F.xxhash64("row", "window"), F.lit(trainers * ROUNDS))
    dealt = windows.select(F.floor(place / ROUNDS).alias("node"), (place % ROUNDS).alias("turn"), "window")
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(params)
        parts = materialize(dealt.where(F.col("turn") == turn).drop("turn").groupBy("node").applyInPandas(_trainer(turn, shared), "node long, n long, params binary"), "lm-parts")
        averaged = _average(parts)
        discard(parts)
        if averaged is None:
            break
        params = averaged
    return shaped(params), slots, share


# ---- scoring ---------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0):
            counts.update((t.as_py() or b"").split())
            counts[b""] += 1  # the end; no word is empty
            if len(counts) > 400_000:
                yield rows()
                counts.clear()
    yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over lower-cased binary texts; the end token is the empty word."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, top: int = TOP) -> tuple[dict[bytes, int], int]:
    """The words counted at least `least` times, and least; the cut is the lowest step of 1/8 octave that keeps at most top."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    steps = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 8 * 63
    total, cut = 0, None
    for s in sorted(steps, reverse=True):
        if total + steps[s] > top:
            break
        total, cut = total + steps[s], s
    if cut is None:
        return {}, 1 << 62
    rows = counts.where(step >= cut).select("word", "c").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), cut


SCORED = "row long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"


def _score(model, words):
    """Rows (row, text, ids) of `numbered`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, slots, share = model.value
        tables, seen, frequent = _tables(params), seen_table(slots), words.value
        nan = math.nan
        cols: list[list] = [[] for _ in range(6)]
        xs, ys, others, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal cols, xs, ys, others, total
            x, y = np.concatenate(xs), np.concatenate(ys)
            per = np.empty((len(y), STRIDE), np.float64)
            for at in range(0, len(x), 2048):
                part = y[at : at + 2048]
                valid = part.reshape(-1) != START
                got = np.zeros(len(valid))
                got[valid] = log_probability(params, tables, x[at : at + 2048], part, valid)
                per[at : at + 2048] = got.reshape(-1, STRIDE)
            starts = np.concatenate([[0], np.cumsum([len(v) for v in ys])[:-1]])
            cols[4] = ((np.add.reduceat(per.sum(axis=1), starts) + np.array(others)) / math.log(10)).tolist()
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCORED.split(", ")])
            cols, xs, ys, others, total = [[] for _ in range(6)], [], [], [], 0
            return out

        for b in batches:
            for row, t, i in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                ws, ids = t.as_py().split(), np.frombuffer(i.as_py(), "<u4")
                x, y = _windows(ids, slots, seen)
                others.append(float(share[ids].sum()))
                ws.append(b"")
                base = np.fromiter(map(frequent.get, ws, repeat(nan)), np.float64, len(ws))
                lost = np.flatnonzero(np.isnan(base))
                for c, v in zip(cols, (row, len(ws), len(ws) - len(lost), float(np.nansum(base)), 0.0, [ws[i] for i in lost]), strict=True):
                    c.append(v)
                xs.append(x)
                ys.append(y)
                total += len(x)
                if total >= 4096:
                    yield flush()
        if xs:
            yield flush()

    return run


def score_documents(docs: DataFrame, train: Column, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = numbered(docs.select("doc_id", "text"), train, path)
    training = rows.where("train")
    counts = materialize(word_counts(training), "word-counts")
    stats = counts.agg(F.sum("c").alias("N"), F.count(F.lit(1)).alias("V")).first()
    n, v = int(stats["N"] or 0), int(stats["V"])
    scale = math.log10(n + v + 1)
    top, least = frequent_words(counts)
    words = spark.sparkContext.broadcast({w: math.log10(c + 1) - scale for w, c in top.items()})
    model = spark.sparkContext.broadcast(fit(training, path))
    scored = materialize(rows.select("row", "text", "ids").mapInArrow(_score(model, words), SCORED), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
    found = rare.join(counts, "word", "left").select("row", "k", F.coalesce("c", F.lit(0)).alias("c"))
    more = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * (F.log10(F.col("c") + 1.0) - F.lit(scale))).alias("_base"))
    out = rows.select("row", "doc_id", "train").join(scored.drop("rare"), "row").join(more, "row", "left")
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 7) == 2
    out = score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
