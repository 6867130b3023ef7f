"""Spelling variants: words one edit apart, by a relational trie frontier.

The edge table of a trie is a distributed table: a node is a hash of a prefix, and an edge jumps over nodes without another
child, so it holds its first character, its length and a hash of the rest of its label. States (word, position, node) start on
a word's own path, where they need no edit. There they make one edit: skip a character of the word, take another child with a
character of the word, or without one. From then on they follow edges that spell the rest of the word, level by level,
until they end on a node as deep as its trie: these terminal one-edit states are neighbours, confirmed on the words themselves.

There is one trie per length of words (an edit decides the length), forwards and backwards. A state makes its
edit in the second half of its trie's direction only; what is changed in a word's first half is found backwards. So
states leave the own path where few words share it.

Defined results: an edit of a repeated letter counts once; a word may take its form from several candidates, the most
frequent first, ties by code points; following forms ends, since counts rise at each step. Empty and null texts have no words; a null doc_id counts as the empty text
in the hash; repeated rows count again; extra columns do not matter; an empty table gives an empty result. Words of any length take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize, read

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, DROP_MOD = 7, 2, 10, 31
#: Hash of a node with a direction and a depth; collisions only make states that the last check removes.
FORWARD, BACKWARD = 0, 1


def typed_words(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): runs of letters, lower-cased (A-Z), one in DROP_MOD of each document's less a character."""
    d = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.filter(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0)), lambda r: F.length(r) >= length)
    each = docs.select(d.alias("_d"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("_d", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % DROP_MOD == 0, shorter).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _node(direction: int, depth: Column, prefix: Column) -> Column:
    """depth: the length of the trie's words."""
    return F.xxhash64(F.lit(direction), depth.cast("int"), prefix)


def edge_table(words: DataFrame, direction: int) -> DataFrame:
    """(node, char, step, label, child) of the tries over words (spelt, size): from half of a word on.

    An edge ends at the next node with two children or at the end of the words.
    """
    first = F.floor((F.col("size") - 1) / 2)
    at = words.select("spelt", "size", F.explode(F.sequence(first, F.col("size") - 1)).alias("pos"))
    own = at.select("spelt", "size", "pos", _node(direction, F.col("size"), F.substring("spelt", F.lit(1), F.col("pos"))).alias("node"), F.substring("spelt", F.col("pos") + 1, F.lit(1)).alias("char"))
    forks = own.groupBy("node").agg((F.min("char") < F.max("char")).alias("fork"))
    # The next fork below each place of a word; its end is one too.
    later = Window.partitionBy("spelt").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    to = F.coalesce(F.min(F.when(F.col("fork"), F.col("pos"))).over(later), F.col("size"))
    reach = own.join(forks, "node").withColumn("to", to)
    step = F.col("to") - F.col("pos")
    label = F.xxhash64(F.substring("spelt", F.col("pos") + 2, step - 1))
    child = _node(direction, F.col("size"), F.substring("spelt", F.lit(1), F.col("to")))
    return reach.select("node", "char", step.cast("int").alias("step"), label.alias("label"), child.alias("child")).dropDuplicates(["node", "char"])


def _spells(start: Column, length: Column, label: Column) -> Column:
    """Whether the state's word has that label at a place (from 0)."""
    return (start + length <= F.length("spelt")) & (F.xxhash64(F.substring("spelt", (start + 1).cast("int"), length.cast("int"))) == label)


def frontier(words: DataFrame, edges: DataFrame, direction: int) -> DataFrame:
    """(spelt, end): words with the last nodes of words one edit away. words: spelt, size.

    A state is (spelt, pos, len, node): len is how long the words of its trie are, and the node's prefix has pos + len - size characters.
    """
    half = F.floor(F.col("size") / 2) if direction == FORWARD else F.ceil(F.col("size") / 2)
    own = words.select("spelt", "size", F.explode(F.sequence(half.cast("int"), F.col("size"))).alias("pos"))
    prefix, char = F.substring("spelt", F.lit(1), F.col("pos")), F.substring("spelt", F.col("pos") + 1, F.lit(1))
    after = F.substring("spelt", F.col("pos") + 2, F.lit(1))
    size, pos = F.col("size"), F.col("pos")
    less = own.where((pos < size) & (char != after)).select("spelt", (pos + 1).alias("pos"), (size - 1).alias("len"), _node(direction, size - 1, prefix).alias("node"))
    turns = own.withColumn("len", F.explode(F.array(size, size + 1))).where((pos < size) | (F.col("len") > size))
    turns = turns.withColumn("node", _node(direction, F.col("len"), prefix)).withColumn("own", char).drop("size").join(edges, "node").where(F.col("char") != F.col("own"))
    taken = pos + (F.col("len") == F.length("spelt")).cast("int")  # the word's own character goes, or the other is put before it
    turns = turns.where(_spells(taken, F.col("step") - 1, F.col("label"))).select("spelt", (taken + F.col("step") - 1).alias("pos"), "len", F.col("child").alias("node"))
    states = materialize(less.union(turns), "states")
    ends = []
    at_end = pos == F.length("spelt")  # the node is then as deep as its trie
    while True:
        ends.append(states.where(at_end).select("spelt", F.col("node").alias("end")))
        moved = states.where(~at_end).withColumn("char", char).join(edges, ["node", "char"]).where(_spells(pos + 1, F.col("step") - 1, F.col("label")))
        states = materialize(moved.select("spelt", (pos + F.col("step")).alias("pos"), "len", F.col("child").alias("node")), "states")
        if states.isEmpty():
            break
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs, in both orders, that differ by one inserted, deleted or replaced code point. words: word, distinct."""
    found = None
    for direction in (FORWARD, BACKWARD):
        turned = (lambda c: F.col(c)) if direction == FORWARD else F.reverse
        sized = words.select(turned("word").alias("spelt"), F.length("word").alias("size"))
        edges = materialize(edge_table(sized, direction), "edges")
        ends = sized.select(F.col("spelt").alias("other"), _node(direction, F.col("size"), F.col("spelt")).alias("end"))
        pairs = frontier(sized, edges, direction).join(ends, "end").where(F.levenshtein("spelt", "other", 1) == 1).select(turned("spelt").alias("word"), turned("other").alias("near"))
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def forms(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """counted: word, n. Per word its most frequent neighbour (form), if frequent enough, and where forms lead (root)."""
    near = neighbours(counted.select("word"))
    known = near.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The most frequent, then the smallest word: strings compare by UTF-8, which is the order of code points.
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("form_n"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("form"))
    joined = counted.join(best, "word", "left")
    enough = F.col("form_n") >= ratio * F.col("n")
    out = joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n"))
    out = materialize(out, "forms")
    # Pointers double: at most log2 of the longest chain, whose counts grow tenfold at each step.
    up = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(up.join(over, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(up)
        up = step.drop("_moved")
        up._logloom_path = step._logloom_path
        if step.where("_moved").isEmpty():
            break
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return forms(materialize(typed_words(docs).where(F.col("n") >= MIN_COUNT), "words"))


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"

ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT concat(doc_id, ':', run) AS key, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) r
  WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), tab AS (SELECT {_TABLE} AS t), crc AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(key)), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM runs, tab
), words AS (
  SELECT word, sum(k)::bigint AS n FROM (SELECT CASE WHEN h % {DROP_MOD} = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM crc) w
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
), cut AS (
  SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM words, unnest(range(length(word))) u(i)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT x.word, x.near, w.n, count(*) OVER (PARTITION BY x.word) AS n_near, row_number() OVER (PARTITION BY x.word ORDER BY w.n DESC, encode(x.near)) AS r
  FROM near x JOIN words w ON w.word = x.near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""
