"""Edge cases and brute-force comparisons of the training-data operators."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from brute import base_sha, base_spans, rule_counts, split_words
from pyspark.sql import functions as F

from logloom.llm import line_dedup, lm_scoring, mixing, near_dedup, packing, private_data, quality_classifier, quality_rules, topk, toxicity
from logloom.llm.graph import components
from logloom.llm.samples import labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = words(rng, 200)
    near = base.split()
    near[17] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "One two three four", "É ü ß 漢字 　 x", base, base, " ".join(near), base.upper(), words(rng, 20_000), "same line here now\n" * 30,
        "mail a.b@c.example.com or a@b.c_d@e.f, card 4111 1111 1111 1111, ip 1.2.3.4.5.6.7.8 and 999.1.1.1, call +1 (555) 010-9999 now", "### $$$ *** !!! " * 20, "a" * 50_000,
        *[words(rng, rng.randrange(5, 300)) for _ in range(40)],
    ]
    rows = [(i, t, "en", ["s0", "s1", None][i % 3] if i % 4 else "s0", 0, "clash") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (1000, base, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark, docs):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(55)] + [(1, 1, None), (None, 1, 1), (2, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas()


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_rules(spark, docs, labels, plain):
    got = quality_rules.quality_rules(docs, labels).toPandas()
    assert len(got) == len(plain)
    got = got.drop_duplicates("doc_id").set_index("doc_id")
    for r in plain.itertuples():
        for k, v in rule_counts(r.text).items():
            assert got.loc[r.doc_id, k] == v, (r.doc_id, k)
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int((~pd.Series([rule_counts(t)["base_failed"] for t in plain.text])).sum())
    assert quality_rules.quality_rules(empty(spark, DOCS), empty(spark, LABELS)).count() == 0


def test_binomial_bound(spark):
    for n, k, p in ((1000, 3, 0.01), (530, 0, 0.01), (50, 20, 0.3)):
        got = spark.range(1).select(quality_rules.binomial_cdf_log(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(math.exp(got) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_rule_cutoffs_keep_their_promise(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 100, 1000, int(rng.integers(0, 20)) if i % 10 else 400, 0, 0, 10, 0, 0, False) for i in range(6000)]
    measured = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_upper long, n_bangs long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(6000)], LABELS)
    judged = quality_rules.judge(measured, quality_rules.calibrate(measured, labels)).toPandas()
    good = judged.doc_id % 10 != 0
    assert (~judged.kept[good]).mean() <= 0.01 and (~judged.kept[~good]).all()


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = [list(map(float, rng.normal(size=8))) for _ in range(700)]
    v[5], v[9], v[11], v[13] = v[4], [float("nan")] * 8, None, [None] * 8
    v[100] = v[4]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    vectors = topk.integer_vectors(df).cache()
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).toPandas()
    usable = {i: [math.floor(1024 * c) for c in x] for i, x in enumerate(v) if i not in (9, 11, 13)}
    for q in range(0, 700, 100):
        want = sorted(((-sum(a * b for a, b in zip(usable[q], x, strict=True)), i) for i, x in usable.items() if i != q))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == want
    none = topk.integer_vectors(empty(spark, "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-1024, 1024, (3000, 16))
    x[:5] *= 20
    q = rng.integers(-1024, 1024, (4, 16))
    for i, may in enumerate(topk.nra(x, q, 3)):
        best = np.argsort(-(x @ q[i]), kind="stable")[:3]
        assert set(best) <= set(may) and len(may) < 3000


def mixed_reference(plain):
    size = [len(split_words(t)) for t in plain.text]
    total = defaultdict(int)
    for s, n in zip(plain.source, size, strict=True):
        total[s if isinstance(s, str) else None] += n
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] >= 2 * total[s]]
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
    return size, total, target


def test_mixing(spark, docs, plain):
    got = mixing.mix_documents(docs).toPandas()
    _, total, target = mixed_reference(plain)
    assert len(got) == len(plain) and (got.taken <= 2 * got["size"]).all()
    for s, part in got.groupby(got.source.astype(object).where(got.source.notna(), "-")):
        key = None if s == "-" else s
        assert (part.source_size == total[key]).all() and np.allclose(part.target, target[key])
        assert abs(part.taken.sum() - target[key]) <= 2
    again = mixing.mix_documents(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns and sum(len(split_words(t)) for t in texts.toPandas().text) == got.taken.sum()
    assert mixing.mix_documents(empty(spark, DOCS)).count() == 0


def test_mixing_cuts_the_sorted_line(spark):
    """The taken words are the first of all words in the order of finish times, by a plain walk; another order takes others."""
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 40)), ["a", "b", "c"][min(i % 7, 2)]) for i in range(90)] + [(200, words(rng, 700), "b"), (201, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.select("doc_id", "source", F.size(mixing.words(F.col("text"))).cast("long").alias("size"), F.col("doc_id").alias("_row"))
    targets = mixing.source_targets(sizes)
    line = mixing.timeline(sizes, targets).cache()
    total = int(1.5 * sizes.agg(F.sum("size")).first()[0])
    got = {(r._row, r["pass"]): r.sent for r in mixing.truncate(line, total).collect()}
    every = [((r.begin + k) / r.target, r.source, r._key, r.doc_id, r["pass"]) for r in line.collect() for k in range(1, r.size + 1)]
    want = Counter((d, p) for _, _, _, d, p in sorted(every)[:total])
    assert got == want
    backwards = Counter((d, p) for _, _, _, d, p in sorted(every, key=lambda x: (-ord(x[1]), x[0]))[:total])
    assert got != backwards
    assert sum(v for v in mixing.truncate(line, 10**9).toPandas().sent) == len(every)


def jaccard_components(plain):
    sets = {}
    for r in plain.itertuples():
        ws = [w for w in (r.text or "").encode().lower().split()]
        sets.setdefault(r.doc_id, {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set()))
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return sets, comp


def test_near_dedup(spark, docs, plain):
    sets, comp = jaccard_components(plain)
    got = near_dedup.link_documents(docs).toPandas()
    assert len(got) == len(plain)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.toPandas().doc_id) == sorted(set(comp.values()))
    assert near_dedup.link_documents(empty(spark, DOCS)).count() == 0


def test_near_dedup_with_two_texts_under_one_id(spark):
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(5, a), (5, b), (5, c), (9, b + " more"), (11, a + " more"), (12, c + " more"), (20, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.link_documents(df).toPandas()
    assert len(got) == len(rows) and got[["doc_id", "component_id"]].drop_duplicates().sort_values("doc_id").values.tolist() == [[5, 5], [9, 5], [11, 5], [12, 5], [20, 20]]
    assert set(got[got.kept].doc_id) == {5, 20}


def test_super_minhash_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300).astype(np.uint64)])
    s = near_dedup.super_minhash([np.unique(a), np.unique(b), a[:1]])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.2 and len(set(s[2].tolist())) == near_dedup.M


def test_components(spark):
    links = [(i + 1, i) for i in range(60)] + [(200, 100), (100, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 100


def test_lines(spark):
    long_line = " ".join(f"token{i}" for i in range(80))
    edited = long_line.replace("token40", "tokenXX")
    rows = [(2, f"keep me please now\n{long_line}"), (1, f"{long_line}\nshort x\nshort x"), (3, edited), (4, None), (5, ""), (None, long_line), (1, f"{long_line}\nshort x\nshort x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    one, two = line_dedup.simhashes([line_dedup.normalise(x.encode()) for x in (long_line, edited)])
    near = np.bitwise_count((one ^ two).view(np.uint64)) <= 3
    assert got[(1, f"{long_line}\nshort x\nshort x")] == (3, 0)
    assert got[(2, "keep me please now")] == (2, 1) and got[(None, "")] == (1, 1)
    assert got[(3, "")] == (1, 1) if near else got[(3, edited)] == (1, 0)
    assert got[(4, None)] == (0, 0) and got[(5, "")] == (1, 0)
    assert line_dedup.dedup_lines(empty(spark, "doc_id long, text string")).count() == 0


def edited_lines():
    """(line, edited line) by name: words replaced, letters replaced or dropped, at many lengths."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 9)))
    pairs = []
    for n in (3, 4, 6, 8, 10, 15, 20, 30, 50, 80):
        for _ in range(12):
            ws = [word() for _ in range(n)]
            other = list(ws)
            other[rng.randrange(n)] = word()
            pairs.append((" ".join(ws), " ".join(other)))
            chars = list(" ".join(ws))
            for i in rng.sample([i for i, c in enumerate(chars) if c != " "], max(1, len(chars) // 12)):
                chars[i] = rng.choice(["", rng.choice(letters)])
            pairs.append((" ".join(ws), "".join(chars)))
    return pairs


@pytest.mark.parametrize("large", [False, True])
def test_line_links_against_brute_force(spark, monkeypatch, large):
    if large:  # every bucket by the path of the large ones, in several blocks
        monkeypatch.setattr(line_dedup, "SMALL", 1)
        monkeypatch.setattr(line_dedup, "BLOCK", 2)
    texts = [x for pair in edited_lines() for x in pair]
    lines = [b" ".join(ws) for ws in (line_dedup.normalise(x.encode()) for x in texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed = 1").collect()}
    top = list(range(len(lines)))
    for j in range(len(lines)):
        for i in range(j):
            if line_dedup.similar(lines[i], lines[j], 80):
                old, new = sorted((top[i], top[j]), reverse=True)
                top = [new if x == old else x for x in top]
    want = {i for i, x in enumerate(top) if x != i}
    assert len(want) > 150 and removed <= want and len(removed) >= 0.98 * len(want)


def test_one_word_edit_is_linked(spark):
    for n in (10, 20, 30, 50):
        line = " ".join(f"{chr(97 + i % 26)}token{chr(97 + i // 26)}" for i in range(n))
        df = spark.createDataFrame([(1, line), (2, line.replace("ctokena", "changed"))], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1}


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (bytes(rng.choices(b"abc", k=rng.randrange(90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        assert line_dedup.edit_distance(a, b) == row[-1]


def _next(prev, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(prev[j] + (x != y), prev[j + 1] + 1, out[j] + 1))
    return out


def test_private_data(spark, docs, plain):
    got = private_data.all_spans(docs).withColumn("sha", F.sha2(F.array_join(F.concat(*[private_data._spans_text(k, F.col(k)) for k in private_data.PATTERNS]), ","), 256)).toPandas()
    assert len(got) == len(plain)
    got = got.drop_duplicates("doc_id").set_index("doc_id")
    for r in plain.itertuples():
        assert got.loc[r.doc_id, "sha"] == base_sha(r.text), base_spans(r.text)
    assert private_data.all_spans(empty(spark, DOCS)).count() == 0
    clean = private_data.sanitise(docs)
    assert clean.columns == docs.columns and "[EMAIL]" in clean.where("doc_id = 12").first().text


def test_revealing_terms(spark):
    rng = random.Random(1)
    rows = [(i, f"{words(rng, 8)} Zebulon wrote {words(rng, 3)} zeb@mail.example.com {words(rng, 6)}") for i in range(6)] + [(i, words(rng, 60)) for i in range(6, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.terms for r in private_data.all_spans(df).collect()}
    assert all(any(rows[i][1][s.start : s.stop] == "Zebulon" for s in got[i]) for i in range(6)) and not any(got[i] for i in range(6, 80))
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(6)] + rows[6:], "doc_id long, text string")
    assert not any(r.terms for r in private_data.all_spans(copies).collect())


def test_revealing_terms_far_from_the_entity(spark):
    rng = random.Random(2)
    names = ("Zebulon", "李雷", "k7")
    rows = [(i, f"Dear {' and '.join(names)}, {words(rng, 70)} zeb@mail.example.com") for i in range(6)] + [(i, words(rng, 60)) for i in range(6, 80)]
    got = {r.doc_id: r.terms for r in private_data.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        found = {rows[i][1][s.start : s.stop] for s in got[i]}
        assert found >= set(names) and "mail" not in found
    assert not any(got[i] for i in range(6, 80))


def test_packing(spark, docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_documents(docs).toPandas()
    want = Counter()
    for r in plain.itertuples():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 4096
    assert packing.pack_documents(empty(spark, DOCS)).count() == 0


def test_reduction_is_optimal_on_small_instances():
    rng = random.Random(0)

    def optimum(items, cap):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= cap and bins[i] not in bins[:i]:
                    bins[i] += items[k]
                    go(k + 1, bins)
                    bins[i] -= items[k]
            go(k + 1, bins + [items[k]])

        go(0, [])
        return best[0]

    for _ in range(150):
        items = sorted((rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))), reverse=True)
        fixed, rest = packing.reduce_instance(Counter(items), 30)
        left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
        assert sorted([x for n, s in fixed for _ in range(n) for x in s] + left) == sorted(items)
        assert sum(n for n, _ in fixed) + (optimum(left, 30) if left else 0) == optimum(items, 30)


def test_classifier_and_toxicity(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        ws = words(rng, 40).split()
        if toxic:
            for k in range(0, 40, 8):
                ws[k] = rng.choice(["grumbler", "Grumbl3r", "nastiness", "nаstiness"])
        text = " ".join(w + ("###" if bad else "") for w in ws)
        rows.append((i, text))
        marks.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame([*rows, (500, None), (501, ""), rows[0]], "doc_id long, text string")
    labels = spark.createDataFrame(marks, LABELS)
    model = quality_classifier.fit(labelled_sample(df, labels, "quality", F.col("doc_id") % 5 != 0, 100))
    got = quality_classifier.score(df, model).toPandas().set_index("doc_id").score
    assert all((got.loc[[i]] >= 0.3).all() == bool(q) for i, q, _ in marks if i % 5 == 0) and got.between(0, 1).all()
    lexicon = toxicity.learn(labelled_sample(df, labels, "toxic", F.col("doc_id") % 5 != 0, 100))
    tox = toxicity.score(df, lexicon).toPandas().set_index("doc_id").score
    assert all((tox.loc[[i]] >= 0.7).all() == bool(t) for i, _, t in marks if i % 5 == 0) and tox[500] == tox[501] == 0
    nothing = labelled_sample(empty(spark, "doc_id long, text string"), labels, "toxic", F.lit(True), 10)
    assert toxicity.learn(nothing) == toxicity.Lexicon() and quality_classifier.fit(nothing)[1] == 0.0
    assert toxicity.score(empty(spark, "doc_id long, text string"), lexicon).count() == 0


def test_exception_phrases():
    lexicon = toxicity.Lexicon({"nasti": 2.0}, ("nastic movement",), 1.0)
    a = toxicity.Lexicon({"nast": 2.0}, ("nastic movement",), 1.0).automaton()
    assert toxicity.weigh(a, "a nastic movement") == 0 and toxicity.weigh(a, "a nasty movement") > 0 and toxicity.weigh(lexicon.automaton(), "NAЅT1ness") > 0


def test_lm(spark, docs, plain):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm_scoring.score_documents(docs, train).toPandas()
    assert len(got) == len(plain)
    counts = Counter()
    for r in plain.itertuples():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([w.lower() for w in split_words(r.text)] + [b""])
    n, v = sum(counts.values()), len(counts)
    got = got.drop_duplicates("doc_id").set_index("doc_id")
    for r in plain.itertuples():
        ws = [w.lower() for w in split_words(r.text)] + [b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        g = got.loc[r.doc_id]
        assert abs(g.base_score - base) < 1e-6 * len(ws) and (g.n_tokens, g.n_known, g.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n) and g.score < 0
    assert lm_scoring.score_documents(empty(spark, DOCS), train).count() == 0


def test_lm_gradients_and_causality():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in lm_scoring.initial(rng.random(lm_scoring.SLOTS)).items()}
    slots = rng.integers(3, lm_scoring.SLOTS, 60).astype(np.int32)
    x, y = lm_scoring.windows_of(slots)
    valid = y.reshape(-1) != lm_scoring.START
    loss = lambda q: -lm_scoring.log_probability(q, lm_scoring._tables(q), x, y, valid).mean()
    g = lm_scoring.gradients(p, x, y, valid)
    for k in ("query", "key", "value", "place", "to_class", "class_bias"):
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[k][at]) < 1e-4 + 0.02 * abs(g[k][at]), k
    changed = slots.copy()
    changed[40] = 3
    one, two = (lm_scoring.log_probability(p, lm_scoring._tables(p), *(w := lm_scoring.windows_of(s)), w[1].reshape(-1) != lm_scoring.START) for s in (slots, changed))
    assert np.allclose(one[:40], two[:40]) and len(one) == 60
    flat = lm_scoring.flat({k: v.astype(np.float32) for k, v in p.items()})
    assert np.array_equal(lm_scoring.flat(lm_scoring.shaped(flat)), flat)


def test_pipeline_small(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.drop("n_words").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns, name
            at.write.parquet(str(tmp_path / name))
            at = spark.read.parquet(str(tmp_path / name))
    assert at.where("length > 4096").count() == 0 and at.count() > 0


def test_mixed_texts_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d", "s", 7, 8, 9, 1.5), (1, "e f", "s", 1, 2, 3, 2.5), (None, "g h i", None, 4, 5, 6, 3.5), (4, None, "s", 0, 0, 0, 4.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, sent int, _row int, target double")
    got = mixing.mixed_texts(docs).collect()
    assert {(r.size, r.sent, r["_row"], r.target) for r in got} <= {(7, 8, 9, 1.5), (1, 2, 3, 2.5), (4, 5, 6, 3.5)}
    assert sum(len(r.text.split()) for r in got) == 13 and all(r.text for r in got)
