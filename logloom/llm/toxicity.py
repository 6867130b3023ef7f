"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding disguises.

Folding lowers the text, maps look-alike letters of other scripts, full-width forms, accents and digit
substitutions to plain letters, and drops zero-width characters. Lexicon entries are word beginnings with a
weight; a word counts once, with its heaviest entry. Exception phrases (an entry and the word after it) take
their words out. The weighted hits per word give the score, rate / (rate + half), where half is set so that
0.7 falls between the labelled toxic and other documents.

Lexicon, exceptions and half are learned from a bounded sample of labelled training rows (`per_class` of each
label), of whose terms at most `entries` enter, those of most toxic texts first; near copies in the sample count once. Without toxic rows the lexicon is empty and all scores are 0.

Defined results: null and empty texts score 0; repeated rows score alike; an empty table gives an empty
result; texts of any length are matched whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, read
from .near_dedup import shingles
from .samples import labelled_sample

THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Look-alikes by letter: Cyrillic, Greek and signs written for Latin letters.
LOOKALIKES = {"a": "аα@", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "h": "һ", "i": "іι1", "j": "ј", "k": "кκ", "m": "м", "n": "пη", "o": "оοσ0", "p": "рρ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ", "z": "2"}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0x80, 0x250):  # accented Latin letters: their base letter
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base.isascii():
            table[c] = base.lower()
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        table[c] = chr(c - 0xFEE0).lower()
    for c in range(0x300, 0x370):  # combining marks
        table[c] = None
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):
        table[c] = None
    for letter, others in LOOKALIKES.items():
        for o in others:
            table[ord(o)] = letter
            table[ord(o.upper()[0])] = letter
    for c in map(ord, "\t\n\x0b\x0c\r\"'([{<*_#.,;:!?-"):
        table[c] = " "
    return table


FOLD = _fold_table()


def fold(text: str | None) -> str:
    return " " + (text or "").lower().translate(FOLD)


def _terms(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(w)
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n])
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    half: float = 1.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            a.add_word(" " + phrase, (len(phrase) + 1, 0.0))
        if len(a):
            a.make_automaton()
        return a


def weigh(automaton, text: str | None) -> float:
    """Weighted hits per word."""
    folded = fold(text)
    if not len(automaton):
        return 0.0
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if w:
            best[at] = max(best.get(at, 0.0), w)
        else:
            excused.append((at, end))
    total, until, at = 0.0, -1, 0
    excused.sort()
    for place in sorted(best):  # hits and exceptions in one pass, both by where they begin
        while at < len(excused) and excused[at][0] <= place:
            until = max(until, excused[at][1])
            at += 1
        if place > until:
            total += best[place]
    return total / max(len(folded.split()), 1) if best else 0.0


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the smallest shingle hash: near copies mostly share it."""
    for b in batches:
        keys = []
        for t in b.column(0):
            s = shingles(t.as_py())
            keys.append(int(s[0].astype(np.int64)) if len(s) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0), b.column(1)], names=["key", "text", "label"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows():
        terms = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
        return pa.RecordBatch.from_arrays(cols, names=["term", "other", "toxic"])

    for b in batches:
        for text, label in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            counts[1 if label else 0].update(_terms(fold((text.as_py() or b"").decode("utf-8", "replace"))))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield rows()
                counts[0].clear(), counts[1].clear()
    yield rows()


def _count_phrases(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                ws = fold((text.as_py() or b"").decode("utf-8", "replace")).split()
                pairs = {f"{a} {z}" for a, z in zip(ws, ws[1:], strict=False) if a in weights or any(a[:n] in weights for n in PREFIXES)}
                counts[1 if label else 0].update(pairs)
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", "other", "toxic"])

    return run


def learn(sample: DataFrame, entries: int = 2000, least_weight: float = 2.5) -> Lexicon:
    """sample: text (binary), label. The lexicon has at most `entries` entries, so it is small on the driver."""
    unique = materialize(sample.select("text", "label").mapInArrow(_once, "key long, text binary, label int").dropDuplicates(["key"]), "sample")
    size = {r["label"]: r["n"] for r in unique.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        return Lexicon()
    counted = unique.mapInArrow(_count_terms, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (n_other + 1.0))
    support = max(3, int(0.004 * n_toxic))
    top = counted.withColumn("w", weight).where((F.col("toxic") >= support) & (F.col("w") >= least_weight)).orderBy(F.desc("toxic"), "term").limit(entries)
    weights = {r["term"]: float(r["w"]) for r in top.collect()}
    phrases = unique.mapInArrow(_count_phrases(weights), "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    harmless = phrases.where("toxic = 0 and other >= 3").orderBy(F.desc("other"), "term").limit(entries)
    lexicon = Lexicon(weights, tuple(r["term"] for r in harmless.collect()))
    rated = unique.mapInArrow(_rate(lexicon), "label int, rate double")
    got = rated.toPandas()  # two numbers per sampled document
    toxic, other = (np.sort(got.rate[got.label == c].to_numpy()) for c in (1, 0))
    cuts = np.unique(np.concatenate([toxic, other, [1e-6]]))
    cuts = np.sqrt(np.maximum(cuts[1:], 1e-6) * np.maximum(cuts[:-1], 1e-6)) if len(cuts) > 1 else cuts
    caught = 1 - np.searchsorted(toxic, cuts) / max(len(toxic), 1)
    wrong = 1 - np.searchsorted(other, cuts) / max(len(other), 1)
    gain = caught - 2 * wrong
    best = cuts[np.flatnonzero(gain >= gain.max() - 1e-12)[-1]]
    # As low as the labelled others allow, halfway on a log scale: less certain texts fall on the toxic side only above them.
    floor = max(other[int(0.999 * (len(other) - 1))] if len(other) else 0.0, 1e-3)
    cut = float(np.sqrt(best * floor)) if floor < best else float(best)
    return Lexicon(weights, lexicon.exceptions, cut * (1 - THRESHOLD) / THRESHOLD)


def _rate(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            rates = [weigh(a, (t.as_py() or b"").decode("utf-8", "replace")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(rates, pa.float64())], names=["label", "rate"])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            rates = np.array([weigh(a, t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rates / (rates + lexicon.half), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark, sf_dir: str, per_class: int = 6000) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    held: Column = crc_mod(F.col("doc_id"), 3) == 1
    lexicon = learn(labelled_sample(docs, labels, "toxic", ~held, per_class))
    return score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
