"""Merkle manifest against a plain recursive version."""

from hashlib import sha256
from zlib import crc32

import pytest

from logloom.llm import manifest as m

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def level_up(nodes):
    return [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, add=0: h(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(level_up(out[-1]))
        return out

    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            node = leaf(r, 1) if crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0 else own
            proof, place = "", i
            for tree, first in ((trees[g], i), (top, k)):
                place = first
                for nodes in tree[:-1]:
                    pair = nodes[place // 2 * 2 : place // 2 * 2 + 2]
                    proof += "".join(x for j, x in enumerate(pair) if j != place % 2)
                    pair[place % 2] = node
                    node, place = h(*pair), place // 2
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def result(spark, rows, levels=m.LEVELS):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    return sorted((tuple(r) for r in m.manifest(m.document_leaves(df), levels).collect()), key=str)


def some(n):
    langs = ["en", "de", None, "", "é", "fr"]
    return [(i * 3 % n, f"text {i}\n" * (i % 4), langs[min(i % 11, 5)] if i % 2 else "en", None if i % 5 == 0 else f"s{i % 3}", None if i % 9 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 167])
def test_equals_the_plain_tree(spark, n):
    assert result(spark, some(n), levels=2) == plain(some(n))


def test_several_segments_at_the_standard_size(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(2100)] + [(7, None, None, None, None)]
    assert result(spark, rows) == plain(rows)


def test_edges(spark):
    assert result(spark, []) == []
    rows = [(None, None, None, None, None), (5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (5, "b", "en", "s", 1), (None, "", "en", None, 0), (1, "x" * 300_000, "en", "s", 2)]
    got = result(spark, rows, levels=1)
    assert got == plain(rows)
    one = result(spark, rows[1:2])[0]
    assert one[1] == one[2] == one[3] and one[4] == h() and one[6]


def test_positions_number_the_log_in_order_of_completion():
    for n in (1, 2, 3, 5, 8, 13, 31):
        order = []

        def walk(level, index, n=n, order=order):
            if level:
                for child in (2 * index, 2 * index + 1):
                    if child < m.level_size(n, level - 1):
                        walk(level - 1, child)
            order.append((level, index))

        walk(m.height(n), 0)
        assert [m.position(*x, n) for x in order] == list(range(len(order)))
        leaves = [sha256(bytes([i])).digest() for i in range(n)]
        log = m.append_log(leaves, m.height(n))
        assert len(log) == len(order) and [log[m.position(0, i, n)] for i in range(n)] == leaves


def test_a_segment_stands_at_its_nodes_positions(spark):
    leaves = spark.createDataFrame([("t", i, 11, sha256(bytes([i])).digest()) for i in range(11)], "tree string, idx long, n long, leaf binary")
    rounds = m.build(leaves, 1)
    got = {r.position: bytes(r.digest) for r in m.log_nodes(rounds, 1).where("round = 0").collect()}
    assert set(got) == {m.position(level, i, 11) for level in (0, 1) for i in range(m.level_size(11, level))}
    log = m.append_log([sha256(bytes([i])).digest() for i in range(11)], m.height(11))
    assert all(log[p] == d for p, d in got.items())
    assert bytes(m.roots(rounds, 1).first().root) == log[-1]
