"""Duplicate detection: a similarity self-join on token sets and titles.

The blended score is 0.65 * Jaccard + 0.35 * title ratio, rounded to 4 places. As the ratio is at most 1, a pair at threshold t
needs a Jaccard of (t - 0.35 - 0.00005) / 0.65 at least. That bound is used for an exact prefix-filtered join on integer
tokens, rarest first; the title ratio (Ratcliff-Obershelp, which no built-in equals) is computed for survivors alone. Where
the bound is not positive pairs match on titles as well: those without a common token need a title ratio of t / 0.35. A ratio is at most twice the common letters, repeats included, over
all letters, so such pairs come from the same join on letters, and those with a common token from an index of tokens. Only at 0 or less do all pairs match.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import blocks
from quarryline.operators.tables import stored

# Words that don't count.
STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "is", "it", "for", "with", "when")
JACCARD_WEIGHT, TITLE_WEIGHT, THRESHOLD, SHARED = 0.65, 0.35, 0.55, 8
# Numbers of a sketch, most ids that are broadcast.
SKETCH, FEW = 4, 1_000_000


def tokens(text: Column) -> Column:
    """Distinct words of [a-zA-Z0-9_./-]{3,} in the lower-cased text, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9_./-]{3,}"), F.lit(0))), F.array(*map(F.lit, STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 0.0).otherwise(common / union)


@F.pandas_udf(T.DoubleType())
def title_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """SequenceMatcher ratio; not symmetric, the earlier row is left."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def shared_terms(a: Column, b: Column) -> Column:
    """The longest eight common tokens, ties by the alphabet."""
    common = F.array_sort(F.array_intersect(a, b), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    return F.slice(common, 1, SHARED)


def jaccard_bound(threshold: float) -> float:
    return (threshold - TITLE_WEIGHT - 0.00005) / JACCARD_WEIGHT


def token_classes(rows: DataFrame) -> DataFrame:
    """set_id, hashes (of its tokens), rep (smallest ord) and members of each distinct token set of rows (ord, tokens) that isn't empty; a stored table."""
    sets = rows.where(F.size("tokens") > 0).select("ord", F.xxhash64("tokens").alias("set_id"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    return stored(sets.groupBy("set_id", "hashes").agg(F.min("ord").alias("rep"), F.count("*").alias("members")), "classes")


def sketch(hashes: Column) -> list[Column]:
    """SKETCH numbers of 64 bits that tell whether an odd number of hashes falls on each bit. Those of two sets differ in as many bits as the sets do in elements, or fewer."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 8).bitwiseAND(63).cast("int"))
    of = lambda k: F.filter(hashes, lambda x: F.pmod(x, F.lit(SKETCH)) == k)
    return [F.aggregate(of(k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x))).alias(f"s{k}") for k in range(SKETCH)]


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with one of the ids (a stored table of one column, which rows have too). Few ids go to the rows; where they are many, joins to come find them."""
    return rows.join(F.broadcast(ids), ids.columns, "left_semi") if ids.limit(FEW + 1).count() <= FEW else rows


def class_pairs(classes: DataFrame, least: float) -> DataFrame:
    """a, b and jaccard (a < b, by set_id) of all pairs of token_classes() with a Jaccard of least (> 0) or more.

    Tokens are ordered by how many sets hold them, rarest first; two sets that reach the bound share one of the first
    n - ceil(least * n) + 1 tokens of each. At the first token that they share, what is left of the shorter one has to be long enough, and
    their sketches may not differ in more bits than the sets may in tokens; both are looked at inside the join, so that few other pairs become rows.
    """
    words = classes.select("set_id", F.explode("hashes").alias("h"))
    counts = words.groupBy("h").agg(F.count("*").alias("df"))
    ordered = words.join(counts, "h").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
    # read several times below
    ordered = stored(ordered.select("set_id", F.col("t.h").alias("t"), F.size("t").alias("n")).select("*", *sketch(F.col("t"))), "ordered")
    bits = [f"s{k}" for k in range(SKETCH)]
    prefix = ordered.select("set_id", "n", *bits, F.posexplode(F.slice("t", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("i", "h"))
    side = lambda p: prefix.select(F.col("set_id").alias(p), "h", *[F.col(c).alias(f"{c}{p}") for c in ("n", "i", *bits)])
    near = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    both_n = F.col("na") + F.col("nb")
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both_n * (least / (1 + least)) - 1e-9
    apart = sum(F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in bits)
    alike = apart <= both_n * ((1 - least) / (1 + least)) + 1e-9
    met = stored(side("a").join(side("b"), "h").where("a < b").where(near & enough & alike).select("a", "b").distinct(), "met")
    needed = among(ordered.select("set_id", "t"), stored(met.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "needed"))
    lists = lambda p: needed.select(F.col("set_id").alias(p), F.col("t").alias(f"t{p}"))
    both = met.join(lists("a"), "a").join(lists("b"), "b")
    return both.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)


def jaccard_pairs(rows: DataFrame, least: float) -> DataFrame:
    """left_ord, right_ord, jaccard for all pairs of rows (ord, tokens); rows with equal sets are paired with each other too."""
    classes = token_classes(rows)
    members = rows.where(F.size("tokens") > 0).select(F.xxhash64("tokens").alias("set_id"), "ord")
    side = lambda p, o: members.select(F.col("set_id").alias(p), F.col("ord").alias(o))
    across = class_pairs(classes, least).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", "jaccard")
    inside = side("s", "x").join(side("s", "y"), "s").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.unionByName(inside).select(F.least("x", "y").alias("left_ord"), F.greatest("x", "y").alias("right_ord"), "jaccard")


def duplicate_classes(rows: DataFrame, threshold: float, classes: DataFrame | None = None) -> DataFrame:
    """left, right (representatives of two token classes, left < right), their members and jaccard, of at least threshold.

    One row for two classes however many copies they have; members tells how many rows each stands for. classes: token_classes(rows), where they are there already.
    """
    classes = token_classes(rows) if classes is None else classes
    side = lambda p, q: classes.select(F.col("set_id").alias(p), F.col("rep").alias(f"{q}_rep"), F.col("members").alias(f"{q}_n"))
    found = class_pairs(classes, threshold).join(side("a", "x"), "a").join(side("b", "y"), "b")
    swap = F.col("x_rep") < F.col("y_rep")
    pick = lambda c, first: F.when(swap == F.lit(first), F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    return found.select(pick("rep", True).alias("left_number"), pick("rep", False).alias("right_number"), pick("n", True).alias("left_members"), pick("n", False).alias("right_members"), "jaccard")


def sharing_pairs(rows: DataFrame) -> DataFrame:
    """left_ord, right_ord of the pairs of rows (ord, tokens) with a common token."""
    words = rows.select("ord", F.explode("tokens").alias("token"))
    met = words.select(F.col("ord").alias("left_ord"), "token").join(words.select(F.col("ord").alias("right_ord"), "token"), "token").where("left_ord < right_ord")
    return met.select("left_ord", "right_ord").distinct()


def title_pairs(rows: DataFrame, least: float) -> DataFrame:
    """left_ord, right_ord of all pairs of rows (ord, title) whose title ratio can be least (> 0) or more: 2 * common / all letters, each letter's repeats numbered. Those shares are
    Jaccard indices of letters, of least / (2 - least) or more. Empty titles have a letter of their own."""
    letters = F.filter(F.split("title", ""), lambda c: c != "")
    numbered = F.transform(F.sequence(F.lit(1), F.size(letters)), lambda i: F.concat(F.get(letters, i - 1), F.size(F.filter(F.slice(letters, F.lit(1), i), lambda c: c == F.get(letters, i - 1))).cast("string")))
    sets = rows.select("ord", "title", F.when(F.col("title") == "", F.array(F.lit(""))).otherwise(numbered).alias("tokens"))
    return jaccard_pairs(sets.select("ord", "tokens"), min(1.0, least / (2 - least))).select("left_ord", "right_ord")


def detect_duplicates(issues: DataFrame, threshold: float = THRESHOLD, text: Column | None = None) -> DataFrame:
    """issue_number, candidate_issue_number, similarity and shared_terms of the pairs at or over the threshold, best first.

    issues: (number, title, ord) and the columns of text (by default title, body and labels).
    """
    from quarryline.operators.scoring import issue_text

    rows = issues.select("number", F.lower("title").alias("title"), "ord", tokens(issue_text() if text is None else text).alias("tokens"))
    least = jaccard_bound(threshold)
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    if least > 0:
        pairs = jaccard_pairs(rows.select("ord", "tokens"), least).join(side("left"), "left_ord").join(side("right"), "right_ord")
    elif threshold > 0:
        met = sharing_pairs(rows).unionByName(title_pairs(rows, (threshold - 0.00005) / TITLE_WEIGHT)).distinct()
        pairs = met.join(side("left"), "left_ord").join(side("right"), "right_ord").withColumn("jaccard", jaccard(F.col("left_tokens"), F.col("right_tokens")))
    else:
        # the result is every pair
        pairs = side("left").join(side("right"), F.col("left_ord") < F.col("right_ord")).withColumn("jaccard", jaccard(F.col("left_tokens"), F.col("right_tokens")))
    scored = pairs.withColumn("similarity", F.round(JACCARD_WEIGHT * F.col("jaccard") + TITLE_WEIGHT * title_ratio("left_title", "right_title"), 4))
    return scored.where(F.col("similarity") >= threshold).select(F.col("left_number").alias("issue_number"), F.col("right_number").alias("candidate_issue_number"), "similarity", shared_terms(F.col("left_tokens"), F.col("right_tokens")).alias("shared_terms"), "left_ord", "right_ord").orderBy(F.desc("similarity"), "left_ord", "right_ord").drop("left_ord", "right_ord")


def duplicate_degrees(issues: DataFrame, threshold: float = THRESHOLD, text: Column | None = None) -> DataFrame:
    """number, degree: in how many pairs of detect_duplicates() each issue is, without making the pairs of copies.

    Issues with equal tokens and titles are of one kind; kinds are compared once. The title ratio of two kinds may reach the
    threshold in one order only; then the members of the other kind that come later (or earlier) are counted.
    """
    from pyspark.sql import Window

    from quarryline.operators.scoring import duplicate_degree, issue_text

    least = jaccard_bound(threshold)
    if least <= 0:
        return duplicate_degree(detect_duplicates(issues, threshold, text))
    rows = issues.select("number", F.lower("title").alias("title"), "ord", tokens(issue_text() if text is None else text).alias("tokens")).where(F.size("tokens") > 0)
    rows = rows.withColumns({"set_id": F.xxhash64("tokens"), "kind": F.sha2(F.concat_ws("|", F.array_join("tokens", " "), "title"), 256)})
    kinds = rows.groupBy("kind", "set_id", "title").agg(F.count("*").alias("n"))
    near = class_pairs(token_classes(rows), least)
    near = near.unionByName(kinds.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("jaccard")).distinct())
    side = lambda p: kinds.select(F.col("set_id").alias(p), F.col("kind").alias(f"k{p}"), F.col("title").alias(f"t{p}"), F.col("n").alias(f"n{p}"))
    met = near.join(side("a"), "a").join(side("b"), "b").where("a <> b OR ka < kb")
    like = lambda x, y: F.round(JACCARD_WEIGHT * F.col("jaccard") + TITLE_WEIGHT * title_ratio(x, y), 4) >= threshold
    met = met.withColumns({"ab": like("ta", "tb"), "ba": like("tb", "ta")})
    both = met.where("ab AND ba").selectExpr("stack(2, ka, nb, kb, na) AS (kind, more)").groupBy("kind").agg(F.sum("more").alias("more"))
    counted = rows.join(kinds.select("kind", "n"), "kind").join(both, "kind", "left").select("number", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("degree"))
    # early, late: the kind whose members have to come first, and the other
    one = met.where("ab <> ba").select(F.when(F.col("ab"), F.col("ka")).otherwise(F.col("kb")).alias("early"), F.when(F.col("ab"), F.col("kb")).otherwise(F.col("ka")).alias("late"))
    ends = one.withColumn("kind", F.col("early")).unionByName(one.withColumn("kind", F.col("late"))).join(rows.select("kind", "number", "ord"), "kind")
    line = Window.partitionBy("early", "late").orderBy("ord")
    before = F.sum(F.when(F.col("kind") == F.col("early"), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum(F.when(F.col("kind") == F.col("late"), 1).otherwise(0)).over(line.rowsBetween(1, Window.unboundedFollowing))
    ordered = ends.select("number", F.coalesce(F.when(F.col("kind") == F.col("early"), after).otherwise(before), F.lit(0)).alias("degree"))
    return counted.unionByName(ordered).groupBy("number").agg(F.sum("degree").alias("degree"))


def duplicate_kinds(issues: DataFrame, threshold: float = THRESHOLD, text: Column | None = None) -> DataFrame:
    """The pairs of detect_duplicates() without those of copies: left_number, right_number (the first issue of two kinds of equal tokens and titles, the earlier one left), how many
    members each kind has, similarity and reverse_similarity (with the left or the right title first; one of them is at or over the threshold) and shared_terms. A kind of several members is also paired with itself."""
    from quarryline.operators.scoring import issue_text

    least = jaccard_bound(threshold)
    if least <= 0:
        raise ValueError(f"at {threshold} titles alone make pairs, so that kinds can't be found by their tokens")
    rows = issues.select("number", F.lower("title").alias("title"), "ord", tokens(issue_text() if text is None else text).alias("tokens")).where(F.size("tokens") > 0).withColumn("set_id", F.xxhash64("tokens"))
    marked = rows.select("set_id", F.size("tokens").alias("n"), blocks.marks(F.col("tokens")).alias("marks"), "title", "ord", "number")
    kinds = stored(marked.groupBy("set_id", "n", "marks", "title").agg(F.min(F.struct("ord", "number")).alias("first"), F.count("*").alias("members")), "kinds")
    repeated = kinds.groupBy("set_id").agg(F.sum("members").alias("rows")).where("rows > 1")
    near = blocks.likely_pairs(kinds.select("set_id", "n", "marks").distinct(), least)
    near = near.unionByName(repeated.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("most")))
    side = lambda p: kinds.select(F.col("set_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("title", "first", "members")])
    met = near.join(side("a"), "a").join(side("b"), "b").where("a <> b OR a_first.ord < b_first.ord OR (a_first = b_first AND a_members > 1)")
    early = F.col("a_first.ord") <= F.col("b_first.ord")
    pick = lambda c, one: F.when(early, F.col(f"a_{c}" if c else "a")).otherwise(F.col(f"b_{c}" if c else "b")) if one else F.when(early, F.col(f"b_{c}" if c else "b")).otherwise(F.col(f"a_{c}" if c else "a"))
    sides = met.select("most", *[pick(c, one).alias(f"{name}_{c or 'set'}") for name, one in (("left", True), ("right", False)) for c in ("", "title", "first", "members")])
    sides = sides.withColumns({"ratio": title_ratio("left_title", "right_title"), "reverse_ratio": title_ratio("right_title", "left_title")})
    blend = lambda j, ratio: F.round(JACCARD_WEIGHT * F.col(j) + TITLE_WEIGHT * F.col(ratio), 4)
    # tokens come for the pairs that can reach the threshold
    hoped = stored(sides.where(F.greatest(blend("most", "ratio"), blend("most", "reverse_ratio")) >= threshold), "hoped")
    needed = among(rows.select("set_id", "tokens"), stored(hoped.select(F.explode(F.array("left_set", "right_set")).alias("set_id")).distinct(), "needed")).dropDuplicates(["set_id"])
    lists = lambda p: needed.select(F.col("set_id").alias(f"{p}_set"), F.col("tokens").alias(f"{p}_tokens"))
    compared = hoped.join(lists("left"), "left_set").join(lists("right"), "right_set").withColumn("jaccard", jaccard(F.col("left_tokens"), F.col("right_tokens")))
    scored = compared.withColumns({"similarity": blend("jaccard", "ratio"), "reverse_similarity": blend("jaccard", "reverse_ratio")})
    kept = scored.where(F.greatest("similarity", "reverse_similarity") >= threshold)
    return kept.select(F.col("left_first.number").alias("left_number"), F.col("right_first.number").alias("right_number"), "left_members", "right_members", "similarity", "reverse_similarity", shared_terms(F.col("left_tokens"), F.col("right_tokens")).alias("shared_terms"))
