"""Spelling variants by errata-trie merging (operator 13).

Words: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased. Where THINNED divides crc32 of `<doc_id>:<run>`, one
code point of the run is deleted, at that number modulo its length. Counted are results of at least SHORTEST code points that occur at
least RAREST times. Words are near if one inserted, deleted or replaced code point makes one of the other.

Search: the words form a trie whose nodes are their prefixes. Each node's heavy child is the one with the most words below it; along a word at most log2 of the number of words
characters are light. A pair of near words parts at one node v, and one of them goes on by a light child there, or ends. So at each light character c of a word v+c+s, and at its end, its subtree is merged into
the rest of v's with one error: c replaced by the heavy character (v+h+s), c skipped (v+s), the heavy character put before c (v+h+c+s): where the merged terminal coincides with a word's, the two are near. Replacements among the
light children of v meet in the node's own errata trie, under v, a joker and s; as v and s are fixed there, no more words meet than there are letters. Each light word is moved into what is larger, none twice at
a node: small to large. A skipped or inserted character that equals the next one is left to the last of the run, so every pair is found exactly once.

A node is known by a 64-bit hash of its prefix. Should two nodes share one, they share a heavy child as well; which child that is decides on the
work alone, and pairs are still found once. Words are counted and nodes are sized by aggregations that combine before the shuffle; nodes near the root, which all words share, are dealt
to several tasks (see common.lookup). Words that meet in an errata trie of light children are not paired: the trie's two most frequent words say enough for each.

A word's form is its near word of largest count n (ties: the smallest in code-point order) where that is RATIO times its own or more; root follows forms to the last. Counts grow
by RATIO along forms, so pointers are followed in few doublings.

Null and empty texts have no words; null doc_id counts as an empty string in the checksum; repeated rows count repeatedly; very long texts and words are read
whole. An empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import INT, LONG, STRING, discard, give_back, lookup, map_in_arrow, pieces, stored, struct, table

THINNED, SHORTEST, RAREST, RATIO = 31, 7, 2, 10
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Stands for any one character in an errata trie; no letter, so no word holds it.
JOKER = "*"
COUNTS = struct(word=STRING, n=LONG)


def runs(text: bytes, ident: bytes, found: re.Pattern[bytes]) -> list[bytes]:
    """The words of one text, with the deletions that the checksum asks for."""
    seed, out = zlib.crc32(ident + b":"), []
    for run in found.findall(text.lower()):
        h = zlib.crc32(run, seed)
        if h % THINNED == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode() if len(letters) > SHORTEST else b""
        if run:
            out.append(run)
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of all words, rare ones too; n is summed over the tasks."""
    taken = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # C3 is the lead byte of U+00C0 to U+00FF and of nothing else
        found, counts = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % SHORTEST), Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=COUNTS.names)

        for batch in batches:
            for part in pieces(batch, 1):
                for i, t in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    counts.update(runs(t, i, found))
                if len(counts) > HELD:
                    yield given()
                    counts.clear()
        yield given()
        counts.clear()
        give_back()

    return map_in_arrow(taken, run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def trie_edges(words: DataFrame) -> DataFrame:
    """wid, depth, node and next for every character of every word, and for its end, where next is null."""

    def run(batches):
        for batch in batches:
            wids, depths, nodes, nexts = [], [], [], []
            for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = 0
                for depth, c in enumerate(word):
                    wids.append(wid)
                    depths.append(depth)
                    nodes.append(node)
                    nexts.append(c)
                    node = ((node ^ ord(c)) * 0x9E3779B97F4A7C15 + depth + 1) & 0x7FFFFFFFFFFFFFFF
                    node ^= node >> 29
                    if len(wids) >= 200_000:
                        yield _edges(wids, depths, nodes, nexts)
                        wids, depths, nodes, nexts = [], [], [], []
                wids.append(wid)
                depths.append(len(word))
                nodes.append(node)
                nexts.append(None)
            yield _edges(wids, depths, nodes, nexts)

    return map_in_arrow(words.select("wid", "word"), run, EDGES)


EDGES = struct(wid=LONG, depth=INT, node=LONG, next=STRING)


def _edges(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=EDGES.names)


def light_places(words: DataFrame) -> DataFrame:
    """word, n, at (0-based), heavy: where a word goes on by a light child of its node, or ends in a node with children; heavy is the node's heavy character."""
    edges = trie_edges(words)
    children = edges.groupBy("node", "next").agg(F.count("*").alias("below"))
    nodes = children.groupBy("node").agg(F.max_by("next", F.when(F.col("next").isNotNull(), F.struct("below", "next"))).alias("heavy"), F.count("*").alias("children"), F.sum("below").alias("below"))
    branching = stored(nodes.where("children > 1").select("node", "heavy", "below"), "nodes")
    light = lookup(edges, branching, ["node"], "below").where("NOT next <=> heavy").select("wid", "depth", "heavy")
    places = light.groupBy("wid").agg(F.collect_list(F.struct(F.col("depth").alias("at"), "heavy")).alias("places"))  # log2 of the words at most
    return words.join(places, "wid").select("word", "n", F.explode("places").alias("p")).select("word", "n", "p.at", "p.heavy")


def _tail(after: Column) -> Column:
    return F.substring("word", after + 1, F.length("word"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n (of the best near word, whatever its count) for the words (wid, word, n) that have near ones."""
    light = stored(light_places(words), "light")
    head, rest = F.substring("word", F.lit(1), F.col("at")), _tail(F.col("at") + 1)
    inside = F.col("at") < F.length("word")
    c, follows = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at") + 2, F.lit(1))
    merged = F.filter(
        F.array(
            F.when(inside, F.concat(head, "heavy", rest)),
            F.when(inside & (c != follows), F.concat(head, rest)),  # an end has no character to skip
            F.concat(head, "heavy", _tail(F.col("at"))),
        ),
        lambda k: k.isNotNull(),
    )
    probes = light.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(merged).alias("word"))
    met = stored(probes.join(words.select("word", "n"), "word"), "met")
    best = lambda n, word: F.min(F.struct((-n).alias("n"), word.alias("word"))).alias("best")
    one = met.groupBy(F.col("a").alias("of")).agg(F.count("*").alias("near"), best(F.col("n"), F.col("word")))
    two = met.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("near"), best(F.col("an"), F.col("a")))
    # errata tries of light children: at most a word for each letter, of which the two best are kept
    errata = light.where(inside).select("word", "n", F.concat(head, F.lit(JOKER), rest).alias("place"))
    gathered = errata.groupBy("place").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).where(F.size("all") > 1)
    three = gathered.select(F.posexplode("all").alias("rank", "own"), (F.size("all") - 1).cast("long").alias("near"), "all").select(F.col("own.word").alias("of"), "near", F.when(F.col("rank") == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("best"))
    found = one.unionByName(two).unionByName(three).groupBy("of").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select(F.col("of").alias("word"), "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: for each word of forms (word, form) where its chain ends. Each round doubles the steps that are taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        stepped = stored(now.join(further, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "chains")
        ended = stepped.where("moved").isEmpty()
        discard(now)
        now = stepped.select("word", "root")
        if ended:
            return now


def variants(docs: DataFrame, text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word."""
    counted = word_counts(docs, text).where(F.col("n") >= RAREST)
    words = stored(counted.withColumn("wid", F.monotonically_increasing_id()), "words")
    found = near_words(words)
    far = F.col("form_n") >= ratio * F.col("n")
    named = words.select("word", "n").join(found, "word", "left")
    judged = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "judged")
    roots = last_forms(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
