"""Mixing sources to target weights by Sainte-Lague apportionment (operator 10). DataFrame functions only.

Target of a source: all words are shared by weight (1, 2, 3, repeating, over the sources by code
point, null last); a source that would get over EPOCHS times its words gets just that, and the excess goes
to the others by weight until none is above.

Blocks: the mix is cut in blocks of BLOCK_WORDS words. Blocks go one by one to the source with the highest quotient target / (2k - 1); the
result is found from the rounded shares and a few quotients around them (apportion). A source's words lie in
shards of about equal size, dealt by a seeded hash of doc_id and text, and its blocks are apportioned
to the shards in the same way, which gives each an integer quota. In a shard the documents stand in seeded order, and their words in a line that is cut in blocks; its quota takes
whole rounds of the shard, and for the rest a seeded selection of blocks: of n blocks r, evenly spaced from a seeded place on (block b is selected where (b * r + place) DIV n
steps up). The word interval of a document in that line says how many of its words lie in selected blocks, so no document gives over EPOCHS times its size.

The result depends on ids, texts and seed alone, not on partitions. Null and empty texts have size 0 and
give nothing. Rows of one doc_id (or none) and one text share a place in the order; repeated rows are documents of their own.
An empty table gives an empty result; very long texts are counted whole; columns besides doc_id, source and text are only carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import stored, table
from quarryline.llm.sqltext import n_words

WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, 20_240_607
BLOCK_WORDS = 8
#: Words of a shard: few enough to sort in a task.
SHARD_WORDS = 500_000


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size; one row each) with weight and target.

    The sources are far fewer than the documents and their windows have one partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # words and weight left for a source and those that reach their bound after it
    level = (F.sum("source_size").over(everything) - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    shared = ranked.withColumn("level", level).withColumn("bound", EPOCHS * F.col("source_size") <= F.col("weight") * F.col("level"))
    first = F.max(F.when(~F.col("bound"), F.struct(-F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    return shared.select("source", "source_size", "weight", F.when(F.col("bound"), (EPOCHS * F.col("source_size")).cast("double")).otherwise(F.col("weight") * first).alias("target"))


def apportion(units: DataFrame, group: list[str], unit: list[str], share: str, seats: str) -> DataFrame:
    """units with quota: the seats of their group dealt by highest quotients share / (2k - 1), ties to the lower unit.

    Rounded shares miss the seats by at most half of the number of units; between them and the result no
    unit's quota moves by more than its part of (miss + units) and one, so only those quotients are compared: fewer
    than five for each unit on average.
    """
    whole = Window.partitionBy(*group)
    even = units.withColumn("_w", F.sum(share).over(whole)).withColumn("_n", F.count("*").over(whole))
    part = F.when(F.col("_w") > 0, F.col(share) / F.col("_w")).otherwise(F.lit(0.0))
    even = even.withColumn("_p", part).withColumn("_q", F.floor(F.col("_p") * F.col(seats) + 0.5).cast("long"))
    even = even.withColumn("_miss", F.when(F.col("_w") > 0, F.col(seats) - F.sum("_q").over(whole)).otherwise(F.lit(0)))
    steps = F.ceil(F.col("_p") * (F.abs("_miss") + F.col("_n"))) + 1
    more = F.when(F.col("_miss") > 0, F.sequence(F.col("_q") + 1, F.col("_q") + steps)).when((F.col("_miss") < 0) & (F.col("_q") > 0), F.sequence(F.greatest(F.lit(1), F.col("_q") - steps), F.col("_q")))
    tried = even.where("_miss <> 0").select(*group, *unit, "_miss", F.col(share).alias("_s"), F.explode(more).alias("_k"))
    quotient = F.col("_s") / (2 * F.col("_k") - 1)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(F.col("_miss") > 0, -quotient).otherwise(quotient), *[F.when(F.col("_miss") > 0, F.hash(u)).otherwise(-F.hash(u).cast("long")) for u in unit], *unit, "_k"))
    moved = tried.withColumn("_r", rank).where("_r <= abs(_miss)").groupBy(*group, *unit).agg(F.sum(F.signum("_miss")).cast("long").alias("_d"))
    keys = list(dict.fromkeys([*group, *unit]))
    out = even.join(moved, keys, "left")
    return out.withColumn("quota", F.col("_q") + F.coalesce("_d", F.lit(0))).drop("_w", "_n", "_p", "_q", "_miss", "_d")


def _key():
    """A source's key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def _order(seed: int):
    """A row's place: by its id and text, so that rows without an id, or with one that others have too, lie in different shards."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _shard():
    """The shard of a document among its source's."""
    return F.pmod(F.xxhash64("order"), "shards")


def _selected(at: str, block: int) -> str:
    """Words in selected blocks among the first `at` words of a shard: SQL over chosen, blocks and place."""
    steps = lambda b: f"(({b}) * chosen + place) DIV blocks"
    first = f"({at}) DIV {block}"
    return f"({block} * ({steps(first)}) + (({at}) % {block}) * ({steps(first + ' + 1')} - {steps(first)}))"


def _placed(docs: DataFrame, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Every row of docs with its place in the mix, and the sources (key, shards). The place: doc_id, size, key, shard, order, source_size, target, rounds (whole ones of the shard), rest
    (the document's words in selected blocks) and first (its words among as many first words of the shard's line)."""
    sized = stored(docs.select("doc_id", "source", _key().alias("key"), n_words(F.col("text")).alias("size"), _order(seed).alias("order")), "sizes")
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = stored(targets(sources).withColumn("key", _key()), "targets")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    quotas = apportion(goals.withColumn("all", F.lit(0)).withColumn("seats", F.lit(total // block)), ["all"], ["key"], "target", "seats")
    quotas = stored(quotas.select("key", "source_size", "target", F.col("quota").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards")), "quotas")
    dealt = sized.join(quotas.select("key", "shards"), "key").withColumn("shard", _shard()).drop("shards", "source")
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).join(quotas, "key")
    shards = apportion(shards, ["key"], ["shard"], "shard_size", "blocks")
    shards = shards.select("key", "shard", "shard_size", "source_size", "target", F.least(F.col("quota") * block, EPOCHS * F.col("shard_size")).alias("words"))
    shards = shards.where("shard_size > 0").withColumns({"rounds": F.expr("words DIV shard_size"), "over": F.expr("words % shard_size"), "blocks": F.ceil(F.col("shard_size") / block)})
    shards = shards.withColumns({"chosen": F.least("blocks", F.floor(F.col("over") / block + 0.5)), "place": F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), "blocks")})
    line = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(line)).join(shards.drop("source_size", "target"), ["key", "shard"], "left").join(quotas.select("key", "source_size", "target"), "key")
    rest = F.expr(f"coalesce({_selected('end', block)} - {_selected('end - size', block)}, 0)")
    first = F.expr("coalesce(least(greatest(over - (end - size), 0), size), 0)")
    return placed.select("doc_id", "size", "key", "shard", "order", "source_size", "target", F.coalesce("rounds", F.lit(0)).alias("rounds"), rest.alias("rest"), first.alias("first")), quotas.select("key", "shards")


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, source, text)."""
    placed, _ = _placed(docs, seed, block_words)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("rest")).alias("taken"))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Whole rows of docs, all their columns, each as often as the mix takes its words (to the nearest whole number, halves up).

    Whole documents can't be taken in blocks, so here the rest of a shard's quota is a first part of its seeded order: the number of rounds and the last place taken
    for each shard say it all, and the documents meet that short table instead of one as long as theirs. Documents with one place in the order go
    together, and empty ones go with their place.
    """
    placed, sources = _placed(docs, seed, BLOCK_WORDS)
    last = F.max(F.when((F.col("first") > 0) & (2 * F.col("first") >= F.col("size")), F.col("order")))
    cuts = stored(placed.groupBy("key", "shard").agg(F.max("rounds").alias("rounds"), last.alias("last")), "cuts")
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select("*", _key(), _order(seed)).toDF(*own, "key", "order").join(sources, "key").withColumn("shard", _shard()).join(cuts, ["key", "shard"])
    times = F.col("rounds") + F.when(F.col("order") <= F.col("last"), 1).otherwise(0)
    copies = rows.withColumn("times", times.cast("int")).where("times > 0")
    return copies.select(*own, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
