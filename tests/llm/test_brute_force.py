"""Training-data operators against plain versions of what their statements say."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import base_spans
from pyspark.sql import functions as F

from logloom.llm import common, line_dedup, lm_scoring, near_dedup, packing, private_data, quality_classifier, toxicity

TEXTS = "doc_id long, text string"


def test_similar_pairs():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(400):
        n = rng.choice([1, 3, 40, 63, 64, 65, 128, 200, 300])
        a = bytes(rng.choices(b"abcd ", k=n))
        b = bytearray(a)
        for _ in range(rng.randrange(max(2, n * 3 // 10))):
            i = rng.randrange(max(1, len(b)))
            b[i : i + rng.randrange(2)] = rng.choice([b"", b"a", b"e"])
        left.append(a)
        right.append(bytes(b) if rng.random() < 0.8 else bytes(rng.choices(b"abcd ", k=n)))
    want = [line_dedup.edit_distance(a, b) * 100 <= 20 * max(len(a), len(b)) for a, b in zip(left, right, strict=True)]
    assert line_dedup.similar_pairs(left, right, 80).tolist() == want and 50 < sum(want) < 400


def test_lines_of_unknown_documents(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, line), (None, line + " more"), (None, "a line of its own that nothing repeats"), (None, "a line of its own that nothing repeated"), (2, "x" * 20_000 + " y z"), (3, "x" * 20_000 + " y z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TEXTS + ", node string")
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, 0, line), (None, 1, ""), (None, 0, min(rows[2][1], rows[3][1], key=lambda t: got_first(spark, t))), (None, 1, ""), (2, 0, rows[4][1]), (3, 1, "")], key=str)


def got_first(spark, text):
    """Documents without an id come in the order of their texts' hashes."""
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def test_quality_scores(spark):
    rng = np.random.default_rng(2)
    projection, bias = rng.normal(size=quality_classifier.BUCKETS), 0.3
    texts = ["", None, "one two two three", "A, b. C!! " * 50, "漢字" * 300, "x" * 5000, "é ü ß", "same same same"]
    got = {r.doc_id: r.score for r in quality_classifier.score(spark.createDataFrame(list(enumerate(texts)), TEXTS), (projection, bias)).collect()}
    for i, t in enumerate(texts):
        ids, counts = quality_classifier.features((t or "").encode())
        z = sum(projection[k] * n for k, n in zip(ids, counts, strict=True)) / sum(counts) + bias
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9), i
    long = quality_classifier.features(("a" * 60 + "bcd").encode())[0]
    assert set(quality_classifier.word_ids(b"a" * 60 + b"bcd")) <= set(long) and quality_classifier.word_ids(b"a" * 60 + b"bcd") != quality_classifier.word_ids(b"a" * 60 + b"xyz")


def test_toxicity_scores(spark):
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({"grum": 2.0, "grumble": 3.5, "nasty": 1.25, "vile": 4.0}, ("grumble softly", "nasty habit"), 0.1)
    pieces = ["grumble", "Grumbl3r", "grumble softly", "nаsty", "nasty habit", "vile", "calm", "word", "—", "​vile"]
    texts = [None, ""] + [" ".join(rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(60)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), TEXTS), lexicon).collect()}
    for i, t in enumerate(texts):
        folded = toxicity.fold(t)
        starts = [m.start() for m in re.finditer(" ", folded)]
        excused = [(s, s + len(p)) for s in starts for p in lexicon.exceptions if folded.startswith(p, s + 1)]
        total = 0.0
        for s in starts:
            hits = [w for term, w in lexicon.weights.items() if folded.startswith(term, s + 1)]
            if hits and not any(a <= s <= b for a, b in excused):
                total += max(hits)
        rate = total / max(len(folded.split()), 1)
        assert math.isclose(got[i], rate / (rate + 0.1), abs_tol=1e-12), t


def test_lm_forward_pass():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.initial(rng.random(lm_scoring.SLOTS)).items()}
    slots = rng.integers(3, lm_scoring.SLOTS, 70).astype(np.int32)
    x, y = lm_scoring.windows_of(slots)
    got = lm_scoring.log_probability(p, lm_scoring._tables(p), x, y, y.reshape(-1) != lm_scoring.START)
    inputs = [lm_scoring.START] * (lm_scoring.CONTEXT + 1) + slots[:-1].tolist()
    for t, target in enumerate(slots):
        first = t // lm_scoring.STRIDE * lm_scoring.STRIDE
        seen = inputs[first : lm_scoring.CONTEXT + t + 1]
        e = np.array([p["embed"][s] + p["place"][i] for i, s in enumerate(seen)])
        weight = np.exp(e @ p["key"] @ (e[-1] @ p["query"]) / math.sqrt(lm_scoring.DIM))
        h = weight @ (e @ p["value"]) / weight.sum() + p["last"][seen[-1]]
        c, m = divmod(int(target), lm_scoring.MEMBERS)
        z, own = p["to_class"] @ h + p["class_bias"], slice(c * lm_scoring.MEMBERS, (c + 1) * lm_scoring.MEMBERS)
        inner = p["to_member"][own] @ h + p["member_bias"][own]
        assert math.isclose(got[t], z[c] - np.log(np.exp(z).sum()) + inner[m] - np.log(np.exp(inner).sum()), abs_tol=1e-6)


def test_lm_counts(spark):
    rng = random.Random(5)
    texts = [None, "", "one"] + [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))) for _ in range(20)]
    rows = lm_scoring.numbered(spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(3), F.col("doc_id") % 2 == 0)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in rows.collect()}
    slots = lm_scoring.slot_table(sorted({int(i) for x in ids.values() for i in x}), lm_scoring.vocabulary_size(None))
    want = Counter()
    for x in ids.values():
        line = [lm_scoring.START, *slots[x].tolist(), lm_scoring.END]
        want.update(a * lm_scoring.SLOTS + b for a, b in zip(line, line[1:], strict=False))
    got = Counter()
    for r in rows.select("ids").mapInArrow(lm_scoring._count_pairs(slots), "pair long, n long").collect():
        got[r.pair] += r.n
    assert got == want and len({r.row for r in rows.collect()}) == len(texts)


def test_subwords_equal_the_tokenizer():
    known = packing.Subwords(packing.vocabulary_path())
    words = ["the", "The,", "É.", "naïve,", "it's,", "x_y.", "A..", ".", ",", "1.", "é1,", "İ.", "漢字,", "co-op.", "straße,", "á,", "ﬁne.", "　x,", "'s,", "Ωmega.", "ÀÉ"]
    for (_, ids), word in zip(known.each(w.encode() for w in words), words, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.tokenizer.encode(word, add_special_tokens=False).ids, word
    assert known.direct


def test_private_terms(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        body = [f"w{rng.randrange(120)}" for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            k = rng.randrange(4)
            body.insert(rng.randrange(len(body)), f"user{k}@mail.example.org")
            if rng.random() < 0.8:
                body.insert(rng.randrange(len(body)), f"Secret{k}")
        rows.append((i, " ".join(body)))
    rows += [rows[0], (1, None), (2, ""), (0, "another text of the same id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TEXTS + ", term string")
    docs = df.select("doc_id", "text")
    got = {(r.entity, r.term) for r in private_data.revealing_terms(private_data.find(docs).cache(), docs).collect()}
    bag = lambda t: {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    holders, contexts, term_rows = defaultdict(set), defaultdict(set), Counter()
    for d, t in rows:
        term_rows.update(bag(t))
        for a, b in base_spans(t)["email"]:
            e = "email:" + t[a:b].lower()
            holders[e].add((d, t))
            contexts[e, d, t].add((t[max(0, a - 120) : a], t[b : b + 120]))
    want = set()
    for e, where in holders.items():
        if len(where) < 3:
            continue
        for term in set().union(*(bag(t) for _, t in where)):
            both = [x for x in where if term in bag(x[1])]
            information = math.log(len(rows) / len(where))
            pmi = math.log(len(both) * len(rows) / (max(term_rows[term], len(both)) * len(where)))
            if len(set().union(*(contexts[e, *x] for x in both))) >= 3 and information > 0 and pmi / information >= 0.8:
                want.add((e, term))
    assert got == want and any(t.startswith("secret") for _, t in got)


def test_least_hashes_decide():
    rng = np.random.default_rng(7)
    for size in (100, 250, 2000):
        for share in (0.5, 0.66, 0.75, 0.9):
            both = round(2 * size * share / (1 + share))
            pool = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:both], pool[size : 2 * size - both]]))
            signatures = near_dedup.super_minhash([a, b])
            alike = float((signatures[0] == signatures[1]).mean())
            least = [np.unique((s[: near_dedup.LEAST] >> np.uint64(32)).astype(np.uint32)) for s in (a, b)]
            may = near_dedup.may_be_similar(0.75, alike, *least, (size, size))
            true = 100 * both >= 75 * (2 * size - both)
            assert may if true else (not may or share > 0.6)
            if size <= near_dedup.LEAST:
                assert may == true or abs(both / (2 * size - both) - 0.75) < 0.02


@pytest.mark.parametrize("kept", [True, False])
def test_pipeline_on_empty_and_odd_tables(spark, tmp_path, kept):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (None, text, None, None, None), (2, None, None, "a", None), (3, "", "en", None, 0)] if kept else []
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, None} and bool(got) == kept


@pytest.mark.parametrize("width, top", [(4096, 1 << 26), (200, 1 << 23), (64, 1 << 20), (3, 1 << 40), (2, (1 << 62) + 5)])
def test_wide_components_have_exact_scores(width, top):
    """Inner products beyond 2**53 and beyond 64 bits, against Python integers."""
    from logloom.llm.topk import _products

    rng = np.random.default_rng(width)
    x, q = (rng.integers(-top, top, (5, width), dtype=np.int64) for _ in range(2))
    x[0], q[0] = top, top
    want = [[min(max(sum(int(a) * int(b) for a, b in zip(r, s, strict=True)), -(1 << 63)), (1 << 63) - 1) for s in q] for r in x]
    assert _products(x, q).tolist() == want


def test_line_links_do_not_depend_on_other_lines(spark):
    """Two lines that are linked alone stay so among many others with the same n-grams."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(400)]
    passage = " ".join(words[:6])
    pairs = []
    for k in range(40):
        line = passage + " " + " ".join(rng.sample(words, 12))
        chars = list(line)
        for i in rng.sample(range(len(passage) + 1, len(line)), 9):
            chars[i] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        pairs.append((2 * k, line, "".join(chars)))
    others = [(1000 + k, passage + " " + " ".join(rng.sample(words, 12))) for k in range(200)]
    rows = [r for k, a, b in pairs for r in ((k, a), (k + 1, b))]
    removed = lambda x: {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(x, TEXTS)).where("n_removed = 1").collect()}
    alone = set().union(*(removed(rows[at : at + 2]) for at in (0, 2)))
    among = removed(rows + others)
    assert alone == {1, 3} and alone <= among and {2 * k + 1 for k in range(40)} <= among


def test_letters_apart():
    rng = random.Random(12)
    lines = [bytes(rng.choices(b"abcdef ", k=rng.randrange(120))) for _ in range(600)]
    apart = line_dedup.letters_apart(lines[:300], lines[300:]).tolist()
    assert all(x <= line_dedup.edit_distance(a, b) for x, a, b in zip(apart, lines[:300], lines[300:], strict=True))
    assert line_dedup.letters_apart([b"abc", b""], [b"cabx", b""]).tolist() == [1, 0]


def test_subwords_of_forms_share_their_stem():
    """Case and punctuation after a word add no word to encode, and the ids stay the tokenizer's."""
    known = packing.Subwords(packing.vocabulary_path())
    forms = ["über", "Über", "ÜBER", "über,", "über.***", "WORD!!", "word", "Word.", "word)\"", "a<\u0338", "x'.", "it's.", "×,", "é,b.", "c3!\x0bd?", "9%", "..,", "ª.", "e\u0301,", "\u0301,", "a,\u00a0b", "n.\x1cb"]
    texts = [*forms, " ".join(forms), "\n".join(forms)]
    for (_, ids), text in zip(known.each(x.encode() for x in texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not {b"word.", b"Word.", b"WORD!!", "über,".encode()} & set(known.known)


def test_missing_pieces_bound_edit_distances():
    """Pieces of a line that stand nowhere in another are never more than their edits, and tell lines of the same syllables apart."""
    rng = random.Random(6)
    syllables = [bytes(rng.choices(b"aeinorst", k=rng.randrange(2, 5))) for _ in range(40)]
    line = lambda: b"".join(rng.choice(syllables) + rng.choice((b"", b" ")) for _ in range(rng.randrange(1, 120)))
    a, b = [line() for _ in range(200)], [line() for _ in range(200)]
    for x in a[:100]:  # near ones
        y = bytearray(x)
        for _ in range(rng.randrange(len(x) // 4 + 1)):
            y[rng.randrange(len(y))] = rng.choice(b"aeinorst ")
        a.append(x)
        b.append(bytes(y))
    a, b = [*a, b"", b"x", b"y" * 5000], [*b, b"abc", b"", b"z" * 3000]
    apart = line_dedup.pieces_apart(a, b).tolist()
    assert all(n <= line_dedup.edit_distance(x, y) for n, x, y in zip(apart, a, b, strict=True))
    unlike = [i for i in range(200) if min(len(a[i]), len(b[i])) > 100]
    assert sum(apart[i] > len(a[i]) // 5 for i in unlike) > 0.8 * len(unlike)


def test_dedup_leaves_little_on_disk(spark):
    """Texts, keys and candidates are deleted before the result is read; what it still needs is not."""
    text = "\n".join(f"line {chr(97 + k)} of many words that say little about {chr(97 + k) * 9}" for k in range(9))
    docs = spark.createDataFrame([(k, text.replace("many", f"many{k % 3}x"), "s", "en") for k in range(40)], "doc_id long, text string, source string, lang string")
    root = common.scratch_dir(spark)
    for make, left in ((line_dedup.dedup_lines, {"lines-gone", "links", "up"}), (near_dedup.keep_one, {"sets", "classes", "labels", "links", "up"})):
        before = set(os.listdir(root))
        out = make(docs)
        made = {re.sub("^logloom-|-[0-9a-f]{32}$", "", f) for f in set(os.listdir(root)) - before if f.startswith("logloom-")}
        assert made <= left
        assert 0 < out.count() <= 40
