"""Spelling variants by an errata trie: words one edit apart, and the commoner form of each.

The trie of all words is laid out as rows. At each node the child with the
most words below is heavy, the others are light, and a word passes at most
log2(words) light edges on its way from the root. Only the light children's
subtrees are merged: into the heavy child's with the node's next character
replaced, into the node itself with it skipped, and, with the heavy character
put before them, for words that end or turn off where the longer word goes on;
light children of one node are merged with each other, their characters left
open. Two words are one edit apart if and only if their ends coincide after one
such step at the node where they part, and then they do so exactly once. A
merged subtree is the list of its words, rewritten, and ends coincide in joins
and groupings on whole words, so no node's subtree meets in one task.

Words are counted over all texts first; what follows grows with the distinct
words. A node is named by its prefix, or from 32 code points on by the
prefix's md5, so long words cost no squared space. Edges with very many words
below are few (their sizes sum up to the words' lengths) and are sent to all
tasks; every other key of a join is small.

Null and empty texts have no words; a null id stands as the empty string in
the draw. Repeated rows count as often as they stand. Ties of counts go to the
smallest word by code points. Other columns of the input are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

RUN = "[A-Za-zÀ-ÿ]+"
#: Shares of all words from which on an edge counts as big: one in so many.
BIG = 1_024
NAMED = 32


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, run): every run of letters of every whole text, A-Z lower-cased."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def misspelt(rows: DataFrame, one_in: int) -> Column:
    """The run, or, where the checksum of id and run is a multiple of ``one_in``, the run less one code point."""
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % one_in == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("run"))


def counted(words: DataFrame, least_length: int, least: int) -> DataFrame:
    """(word, n) of the words that are long and common enough."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _prefix(word: str, depth: Column) -> Column:
    return F.substring(F.col(word), F.lit(1), depth)


def _rest(word: str, depth: Column) -> Column:
    """From code point ``depth`` (counted from 0) on."""
    return F.substring(F.col(word), depth + 1, F.length(word))


def _node(prefix: Column, depth: Column) -> Column:
    return F.when(depth < NAMED, prefix).otherwise(F.md5(prefix))


def paths(words: DataFrame) -> DataFrame:
    """(word, n, depth, node, c): a row for each edge of a word's path; ``c`` is the character after the node."""
    d = F.col("depth")
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    return steps.select("word", "n", "depth", _node(_prefix("word", d), d).alias("node"), F.substring(F.col("word"), d + 1, F.lit(1)).alias("c"))


def edges(steps: DataFrame) -> DataFrame:
    """(node, c, size, heavy): each edge, the words below it, and its node's heavy character."""
    kids = steps.groupBy("node", "c").agg(F.count("*").alias("size")).groupBy("node").agg(F.max(F.struct("size", "c")).alias("top"), F.collect_list(F.struct("c", "size")).alias("kids"))
    return kids.select("node", F.col("top.c").alias("heavy"), F.explode("kids").alias("k")).select("node", "k.c", "k.size", "heavy")


def turns(words: DataFrame, count: int) -> DataFrame:
    """(word, n, depth, c, heavy): each light edge on a word's path, and its end (``c`` null) if its node goes on."""
    steps, big = paths(words), count // BIG + 1
    all_edges = cut(edges(steps))
    # At most BIG times the mean length of a word are big, as all sizes sum up to the words' lengths.
    named = F.broadcast(all_edges.filter(F.col("size") >= big).drop("size"))
    seen = steps.join(named, ["node", "c"], "left")
    rest = seen.filter("heavy is null").drop("heavy").join(all_edges.filter((F.col("size") < big) & (F.col("c") != F.col("heavy"))).drop("size"), ["node", "c"])
    light = seen.filter("c <> heavy").select("word", "n", "depth", "c", "heavy").union(rest.select("word", "n", "depth", "c", "heavy"))
    length = F.length("word")
    ends = words.withColumn("node", _node(F.col("word"), length)).join(all_edges.filter("c = heavy").select("node", "heavy"), "node")
    return light.union(ends.select("word", "n", length.alias("depth"), F.lit(None).cast("string"), "heavy"))


def near(words: DataFrame, count: int) -> DataFrame:
    """(word, n_near, best): for each word with a near one, how many there are and the commonest (n negated, word)."""
    d, c = F.col("depth"), F.col("c")
    at = cut(turns(words, count))
    before, here, after = _prefix("word", d), _rest("word", d), _rest("word", d + 1)
    # Skipped: not where the next character is the same, for then the words part further on.
    skipped = F.when(c.isNotNull() & (F.substring(F.col("word"), d + 2, F.lit(1)) != c), F.concat(before, after))
    inserted = F.concat(before, F.col("heavy"), here)
    replaced = F.when(c.isNotNull(), F.concat(before, F.col("heavy"), after))
    probes = at.select("word", "n", F.explode(F.array(skipped, inserted, replaced)).alias("other")).filter("other is not null")
    pairs = probes.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    found = pairs.select(F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.lit(1).cast("long").alias("k"), F.struct((-F.col(m)).alias("n"), F.col(b).alias("word")).alias("best")) for a, b, m in (("word", "other", "m"), ("other", "word", "n"))])).alias("x")).select("x.*")
    # Light children of one node: words alike but for one open character, no more than the alphabet has.
    open_ = at.filter(c.isNotNull()).groupBy(F.concat(before, F.lit("\x00"), after)).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).filter(F.size("all") > 1)
    each = open_.select("all", F.explode("all").alias("one"))
    found = found.union(each.select("one.word", (F.size("all") - 1).cast("long"), F.when(F.col("all")[0] == F.col("one"), F.col("all")[1]).otherwise(F.col("all")[0])))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) of words with a form (word, form): follows forms to the last, twice as far at each join.

    A form is ``times`` as common as its word, so a chain is no longer than that power of the largest count.
    """
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(1 + math.log(max(most, 2), times))))):
        out = cut(out.join(out.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out


def grouped(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), each word once."""
    words = cut(words)
    count, most = words.agg(F.count("*"), F.max("n")).first()
    rows = words.join(near(words, count), "word", "left")
    commoner = -F.col("best.n") >= times * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(commoner, F.col("best.word")).alias("form"), F.when(commoner, -F.col("best.n")).alias("form_n")))
    roots = rooted(rows.filter("form is not null"), most or 0, times)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"))
    return grouped(counted(found.select(misspelt(found, 199).alias("word")), 6, 5))


#: Plain SQL: every checksum bit by bit, pairs by what is left without one code point, roots by recursion.
OP11_SQL = """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each_run AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS said FROM runs GROUP BY ALL),
bytes AS (SELECT run, k, list_transform(range(1, (length(hex(encode(said))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(said)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS b FROM each_run),
crcs AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(t[(xor(a, x) % 256 + 1)::BIGINT], a >> 8))) AS h FROM bytes, tab),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, k FROM crcs),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY 1),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL SELECT up.word, forms.form, step + 1 FROM up JOIN forms ON forms.word = up.last WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(last, step) AS root FROM up GROUP BY 1) USING (word)
"""
