"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut into full pieces and a rest. All that packing needs is how many
pieces there are of each length, at most `capacity` numbers, so these alone reach the driver. There, the
Martello-Toth reduction fixes sets of up to three pieces that dominate every other set with their largest
piece (a perfect pair; the only, or the best, partners that fit), in bulk for all pieces of equal length;
the remaining lengths are placed best fit, longest first, again in bulk. The plan says which ranks of each
length go where. Pieces find their rank by a distributed running count and look up their place.

Defined results: a null or empty text is the end token alone; repeated rows are packed as documents of their
own; a null doc_id is kept as null; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, running_total

CAPACITY = 4096
END = b"\x01\x00\x00\x00"
#: Words whose ids a Python worker takes up (about 200 bytes each) before it lets go of those it has not met since it last did so.
CACHE = 500_000
#: Words that the tokenizer neither splits nor folds but for their case, and how it writes the bytes that are not printable.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_UNPRINTED = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
WRITTEN = "".join(chr(256 + _UNPRINTED.index(b)) if b in _UNPRINTED else chr(b) for b in range(256))
#: ASCII punctuation but apostrophes that ends a word after a letter or digit; the tokenizer takes it as a piece of its own.
ENDING = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*(?![^ \t-\r])")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids(dict):
    """Ids by word; those of a word that is missing are found and kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class Subwords:
    """Subword ids of words (bytes), as little-endian uint32 bytes.

    The tokenizer never joins anything across blanks, so words can be encoded one by one and kept. Nor does it join a
    letter or digit with punctuation after it, and it lowers A-Z, so texts are lowered and ENDING split off first, and few forms of a word are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _Ids(self._find)
        self.before: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probes = ["word", "Né", "straße", "overthrown", "àÿx"]
        self.direct = [self._plain(w) for w in probes] == self._encode(probes)

    def _plain(self, word: str) -> bytes:
        """A plain word goes to the merging model as it is, without the steps before it."""
        written = charmap_decode(word.lower().encode(), "strict", WRITTEN)[0]
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _find(self, word: bytes) -> bytes:
        """The ids of a word in which A-Z are lowered."""
        if (ids := self.before.get(word)) is not None:
            return ids
        if self.direct and word.isalpha():  # ASCII letters are written as they are
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode("utf-8", "replace")
        return self._plain(text) if self.direct and PLAIN.fullmatch(text) else self._encode([text])[0]

    def each(self, texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], bytes]]:
        """The words of each text, as they are looked up, and their ids."""
        for text in texts:
            if len(self.known) > CACHE:
                self.known, self.before = _Ids(self._find), self.known
            words = ENDING.sub(rb" \g<0>", text.lower()).split()
            yield words, b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    """One table per Python worker, shared by the tasks that it runs one after another."""
    return Subwords(path)


def _tokenize(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = subwords(path or vocabulary_path())
        for b in batches:
            rows: list[tuple] = []
            for doc_id, (_, ids) in zip(b.column(0).to_pylist(), known.each(text.as_py() or b"" for text in b.column(1)), strict=True):
                ids += END
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, k, at, len(part) // 4, crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document. path: the tokenizer's file, by default that of public_tokenizers on each machine."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_tokenize(path, capacity), PIECES)


class _Stock:
    """Counts by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.n)

    def take(self, bag: Counter, times: int) -> None:
        for length, m in bag.items():
            self.n[length] -= m * times
            if not self.n[length]:
                del self.n[length]
                self.order.remove(length)

    def largest(self, limit: int, used: Counter) -> int | None:
        """Largest length up to limit of which a piece is left besides those used."""
        k = bisect_right(self.order, limit)
        while k:
            k -= 1
            if self.n[self.order[k]] > used[self.order[k]]:
                return self.order[k]
        return None

    def smallest(self, count: int, used: Counter) -> list[int]:
        out: list[int] = []
        for length in self.order:
            out += [length] * min(self.n[length] - used[length], count - len(out))
            if len(out) == count:
                break
        return out

    def best_lesser(self, room: int, used: Counter) -> int:
        """The largest d such that two pieces of at least d, besides those used, fit into room; 0 if no two fit."""
        k = bisect_right(self.order, room // 2)
        while k:
            k -= 1
            d = self.order[k]
            left = self.n[d] - used[d]
            if left >= 2:
                return d
            if left == 1:
                up = next((x for x in self.order[k + 1 :] if self.n[x] > used[x]), None)
                if up is not None and d + up <= room:
                    return d
        return 0


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple]], dict[int, int]]:
    """Martello-Toth reduction: ([(number of bins, lengths in each)], what is left)."""
    stock, fixed = _Stock(counts), []
    for j in sorted(stock.n, reverse=True):
        while stock.n.get(j):
            used = Counter({j: 1})
            room = capacity - j
            least = stock.smallest(3, used)
            best = stock.largest(room, used)
            if best is None:
                chosen = Counter({j: 1})  # nothing fits beside it
            elif best == room or (len(least) < 2 or sum(least[:2]) > room):
                chosen = used + Counter({best: 1})  # fills the bin, or only one more fits: the largest
            elif len(least) < 3 or sum(least) > room:  # at most two more fit
                with_best = used + Counter({best: 1})
                second = stock.largest(room - best, with_best)
                if second is None or stock.best_lesser(room, used) > second:
                    break
                chosen = with_best + Counter({second: 1})
            else:
                break
            times = min(stock.n[x] // m for x, m in chosen.items())
            fixed.append((times, tuple(sorted(chosen.elements(), reverse=True))))
            stock.take(chosen, times)
    return fixed, stock.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Best fit decreasing, for all pieces of a length at once: [(number of bins, ((length, times), ...))].

    The fullest bin that takes a piece keeps taking pieces of the same length until it is too full, so bins of
    one filling are treated together; each length splits at most one group of bins.
    """
    groups: dict[int, list[list]] = {}  # room -> [[bins, contents]]
    rooms: list[int] = []

    def put(room: int, bins: int, contents: tuple) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([bins, contents])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k == len(rooms):
                put(capacity, left, ())
                continue
            room = rooms[k]
            bins, contents = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            per = room // length
            full = min(bins, left // per)
            if full:
                put(room - per * length, full, (*contents, (length, per)))
                left -= full * per
                bins -= full
            if bins and left and left < per:
                put(room - left * length, 1, (*contents, (length, left)))
                left, bins = 0, bins - 1
            if bins and contents:
                put(room, bins, contents)
    return [(bins, contents) for room in sorted(groups) for bins, contents in groups[room] if contents]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (first index, first sequence, pieces per sequence, offset, length), sorted by first index.

    Indexes number all pieces by length, then in any fixed order. From first index on, pieces go to sequences
    first sequence, + 1, ..., so many to each, beginning at offset.
    """
    fixed, rest = reduce_instance(counts, capacity)
    bins = [(n, tuple(Counter(x).items())) for n, x in fixed] + best_fit(rest, capacity)
    following, at = {}, 0
    for length in sorted(counts):
        following[length] = at
        at += counts[length]
    rows, sequence = [], 0
    for n, contents in bins:
        offset = 0
        for length, per in contents:
            rows.append((following[length], sequence, per, offset, length))
            following[length] += n * per
            offset += per * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to PIECES. cut should be materialized; it is read twice."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    shared = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            index = b.column(b.schema.get_field_index("_index")).to_numpy(zero_copy_only=False)
            first, sequence, per, offset, length = (table[np.searchsorted(table[:, 0], index, side="right") - 1].T if len(index) else np.empty((5, 0), np.int64))
            k = index - first
            own = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence + k // per), pa.array(offset + k % per * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    indexed = running_total(cut, order, F.lit(1), "_index", "pieces")
    return indexed.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(materialize(pieces(docs), "cut"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
