"""Spelling variants against all pairs."""

import random
from collections import Counter
from zlib import crc32

from logloom.llm import spelling as m
from logloom.llm.registry import ORACLE_SQL


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def typed(docs):
    import re

    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            x = crc32(f"{'' if d is None else d}:{run}".encode())
            if x % 31 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain(n):
    out, form = [], {}
    links = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def result(spark, docs):
    df = spark.createDataFrame([(*d, "w", 3) for d in docs], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in m.forms(m.typed_words(df).where("n >= 2")).collect())


def counted(spark, n):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted(tuple(r) for r in m.forms(df).collect())


def test_equals_all_pairs_over_documents(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(40)] + ["Straßenbahn", "STRAßENBAHN", "grüne×felder"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(200)) + "\n7x7.") for i in range(30)] + [(None, "Wörterbuch wörterbuch"), (3, None), (3, ""), (3, base[0])]
    assert result(spark, docs) == plain(typed(docs))


def test_dense_words_repeated_letters_and_chains(spark):
    rng = random.Random(6)
    words = {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 500, "aaaaaaaaab": 6000, "aaaaaaabab": 2, "xaaaaaaa": 2, "aaaxaaaa": 2}
    while len(words) < 400:
        words["".join(rng.choice("ab") for _ in range(rng.randint(7, 9)))] = rng.choice([2, 3, 25, 300])
    assert counted(spark, words) == plain(words)


def test_long_words_and_edges(spark):
    long = "".join(random.Random(7).choice("abcdefghij") for _ in range(3000))
    words = {long: 30, long[:1500] + long[1501:]: 2, "z" + long[1:]: 3, long + "q": 2, long[:-2] + "zz": 2, "alleine": 2, "ÿÿÿÿÿÿÿ": 2, "ÿÿÿÿÿÿz": 20}
    assert counted(spark, words) == plain(words)
    assert counted(spark, {}) == []
    assert counted(spark, {"einzeln": 2}) == [("einzeln", None, "einzeln", 2, 0, None)]


def test_ties_go_to_the_smaller_word(spark):
    words = {"tausend": 2, "tausond": 50, "tausand": 50, "tausénd": 50}
    assert counted(spark, words) == plain(words)
    assert dict((r[0], r[1]) for r in counted(spark, words))["tausend"] == "tausand"


def test_sql_is_given():
    assert "op11_spelling" in ORACLE_SQL
