"""SimHash classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from logloom.llm import simhash as m
from logloom.llm.common import materialize
from logloom.llm.graph import components


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def groups(keys):
    """Smallest position reachable, by all pairs."""
    top = list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] ^ keys[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def crowd(rng, n, flips):
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        x = base
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize("large", [m.LARGE, 5])
def test_components_of_crowds_and_strays(spark, large):
    rng = random.Random(large)
    keys = sorted({0, (1 << 64) - 1, 7, *crowd(rng, 150, 6), *crowd(rng, 80, 3), *(rng.getrandbits(64) for _ in range(150))})
    pairs = spark.createDataFrame([(signed(k),) for k in keys], "print long")
    label = {r.node: r.component for r in components(materialize(m.links(pairs, large))).collect()}
    got, want = {}, {}
    for i, (k, c) in enumerate(zip(keys, groups(keys), strict=True)):
        got.setdefault(label.get(signed(k), signed(k)), []).append(i)
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_pairs_at_the_budget_in_every_block():
    """Two fingerprints whose three differing bits lie anywhere are linked in exactly one turn."""
    rng = random.Random(3)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        found = 0
        for turn in range(m.BLOCKS):
            block, rest = m.turned(np.array([a, b], np.uint64), turn)
            if block[0] == block[1]:
                found += len(m.trie_join(rest, np.zeros(2, bool), turn)[0])
        assert found == int((a ^ b).bit_count() <= 3)


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_documents(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    texts = base + [t.upper() for t in base[:5]] + [t.replace("w1 ", "v1 ") for t in base] + [None, "", " \t", "Ä ä", "one two", "one two", "big " * 70_000]
    rows = [(100 - i, t, "doc", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, print int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in m.link_documents(df.select("doc_id", "text", "fingerprint", "print")).collect()}
    ordered = sorted((r[0], plain_print(r[1])) for r in rows)
    ids = [r[0] for r in ordered]
    assert got == {d: (f"{p:016x}", ids[c]) for (d, p), c in zip(ordered, groups([r[1] for r in ordered]), strict=True)}


def test_edges(spark):
    schema = "doc_id long, text string, component_id int"
    assert m.link_documents(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d", 1), (None, "", 1), (4, "", 1), (4, "x y z", 1), (2, "x y z", 1), (9, "x y z", 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in m.link_documents(df).collect()), key=str)
    assert got == sorted([(None, None), (None, 4), (4, 4), (4, 2), (2, 2), (9, 2)], key=str)


def test_shingles_repeat_and_match_the_engine(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("un deux trois")).alias("h")).first().h
    assert signed(m.fingerprint(b"Un DEUX trois")) == got
    assert m.fingerprint(b"a b c " * 3) == plain_print("a b c " * 3)
