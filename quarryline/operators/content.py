"""Which files hold an issue's identifiers and words: postings made once for each file, and equi-joins of them with what issues ask for.

A name without dots stands in a source where no character that can be part of a name touches it, so it is one of the source's maximal runs of such
characters, in lower case. A dotted name counts as it is written, where neither such a character nor a dot touches it: a maximal run of those and dots. A word is found anywhere
within letters and digits, so it lies within one of the source's runs of them; runs are found by four of the word's characters and then looked at. No issue is
compared with a file that holds none of its names or words.

Sources of over MOST_CONTENT characters and those with NUL are not read, nor are null ones. What is part of a name depends on the file's language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators.tables import FEW, small, spread

MOST_CONTENT, LEAST_NAME, LEAST_WORD, GRAM = 1_000_000, 3, 4, 4
# Characters that go on a name (Unicode's categories, with the characters that it adds to them and takes from them), what
# ECMAScript has besides, and where lines end.
CATEGORIES = r"\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}"
ADDED = r"\u00b7\u0387\u1369-\u1371\u19da\u2118\u212e\u30fb\uff65"
NAME_ADDED, NAME_TAKEN = r"\u200c\u200d", r"\u037a\u2e2f\ufc5e-\ufc63\ufdfa\ufdfb\ufe70\ufe72\ufe74\ufe76\ufe78\ufe7a\ufe7c\ufe7e"
SCRIPT_ADDED, SCRIPT_TAKEN = r"\u309b\u309c$\u200c\u200d", r"\u2e2f"
LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
SCRIPT_LANGUAGES = ("JavaScript", "TypeScript")


def name_class(script: bool = False, also: str = "") -> str:
    """A pattern for one character that goes on a name."""
    added, taken = (SCRIPT_ADDED, SCRIPT_TAKEN) if script else (NAME_ADDED, NAME_TAKEN)
    # ASCII characters are told without the categories
    return f"[{ascii_class(script, also)}[[^\\x00-\\x7f]&&[{CATEGORIES}{ADDED}{added}]&&[^{taken}]]]"


def ascii_class(script: bool = False, also: str = "") -> str:
    """The ASCII characters of name_class(), without brackets."""
    return f"A-Za-z0-9_{'$' if script else ''}{also}"


def _runs(text: Column, script: bool, also: str, times: str) -> Column:
    """Runs of characters that go on a name; texts of ASCII alone don't need Unicode's tables."""
    plain = F.octet_length(text) == F.length(text)
    of = lambda one: F.regexp_extract_all(text, F.lit(f"{one}{times}"), F.lit(0))
    return F.when(plain, of(f"[{ascii_class(script, also)}]")).otherwise(of(name_class(script, also)))


def names_in(line: Column, script: bool) -> Column:
    """Lower-cased names of LEAST_NAME characters or more."""
    return _runs(F.lower(line), script, "", f"{{{LEAST_NAME},}}")


def chains_in(line: Column, script: bool) -> Column:
    """Dotted names as written, with all that dots tie to them."""
    return F.when(F.contains(line, F.lit(".")), F.filter(_runs(line, script, ".", "+"), lambda x: x.contains("."))).otherwise(F.array().cast("array<string>"))


def readable(files: DataFrame) -> DataFrame:
    return files.where((F.length("content") <= MOST_CONTENT) & ~F.contains("content", F.lit("\x00")))


def _tokens() -> Column:
    """struct(token, dotted) of all names and dotted names of a line (columns text and script)."""
    pick = lambda f: F.when(F.col("script"), f(F.col("text"), True)).otherwise(f(F.col("text"), False))
    tag = lambda tokens, dotted: F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.lit(dotted).alias("dotted")))
    return F.concat(tag(pick(names_in), False), tag(pick(chains_in), True))


def name_postings(files: DataFrame) -> DataFrame:
    """repository, path, token, dotted, line: where each name and dotted name first stands in a file (repository, path, content)."""
    script = X.language(F.col("path")).isin(*SCRIPT_LANGUAGES)
    lines = readable(files).select("repository", "path", F.coalesce(script, F.lit(False)).alias("script"), F.posexplode(F.split("content", LINE_ENDS)).alias("at", "text"))
    rows = lines.select("repository", "path", (F.col("at") + 1).alias("line"), F.explode(_tokens()).alias("t"))
    return rows.groupBy("repository", "path", "t.token", "t.dotted").agg(F.min("line").alias("line"))


def word_postings(files: DataFrame) -> DataFrame:
    """repository, path, run: distinct runs of letters and digits of LEAST_WORD or more, in lower case."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(f"[a-z0-9]{{{LEAST_WORD},}}"), F.lit(0)))
    return readable(files).select("repository", "path", F.explode(runs).alias("run")).distinct()


def grams(text: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """Distinct substrings of the given lengths."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def holding(needles: DataFrame, texts: DataFrame, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """needle, text: texts (text, distinct) with the needles (needle, distinct, as long as the least size) that they contain, from an equi-join on a needle's first characters."""
    first = needles.select("needle", F.left("needle", F.least(F.length("needle"), F.lit(max(sizes)))).alias("gram"))
    return texts.select("text", F.explode(grams(F.col("text"), sizes)).alias("gram")).join(first, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text").distinct()


def asked_names(issues: DataFrame) -> DataFrame:
    """issue_id, repository, identifier, token, dotted: what issues (with arrays identifiers and explicit_identifiers) look for. A dotted identifier whose last part is an identifier itself is left to that."""
    found = F.array_distinct(F.concat("identifiers", "explicit_identifiers"))
    bare = F.filter(found, lambda i: ~i.contains("."))
    wanted = F.filter(found, lambda i: ~i.contains(".") | ~F.array_contains(bare, F.substring_index(i, ".", -1)))
    rows = issues.select("issue_id", "repository", F.explode(wanted).alias("identifier")).withColumn("plain", F.btrim("identifier", F.lit(X.QUOTES)))
    dotted = F.col("plain").contains(".")
    return rows.select("issue_id", "repository", "identifier", F.explode(F.when(dotted, F.array("plain")).otherwise(X.identifier_variants(F.col("plain")))).alias("token"), dotted.alias("dotted"))


def identifier_hits(issues: DataFrame, postings: DataFrame) -> DataFrame:
    """issue_id, path, identifiers (sorted), line: files that hold identifiers of an issue, and the first line with one."""
    met = asked_names(issues).join(postings, ["repository", "token", "dotted"])
    return met.groupBy("issue_id", "path").agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"), F.min("line").alias("line"))


def word_hits(issues: DataFrame, postings: DataFrame) -> DataFrame:
    """issue_id, path, words (sorted): files that hold words of an issue (array content_terms) of LEAST_WORD characters or more."""
    asked = issues.select("issue_id", "repository", F.explode(F.array_distinct("content_terms")).alias("needle")).where(F.length("needle") >= LEAST_WORD)
    met = holding(asked.select("needle").distinct(), postings.select(F.col("run").alias("text")).distinct())
    found = asked.join(met, "needle").join(postings.withColumnRenamed("run", "text"), ["repository", "text"])
    return found.groupBy("issue_id", "path").agg(F.array_sort(F.collect_set("needle")).alias("words"))


def found(issues: DataFrame, files: DataFrame) -> DataFrame:
    """repository, path, value, line: identifiers (with their first line) and words (without one) of a file that any issue asks for.

    Sources are dealt by path once. Of their names and words those that an issue asks for are kept, a row for a file and name or word and not for each issue;
    no posting is exchanged where what is asked for is short enough to broadcast.
    """
    names = small(asked_names(issues).select("repository", "token", "identifier").distinct(), "asked", FEW)
    words = small(_asked_words(issues).select("repository", "needle", F.left("needle", F.lit(GRAM)).alias("gram")).distinct(), "asked", FEW)
    own = spread(files.select("repository", "path", "content"), "path")
    script = F.coalesce(X.language(F.col("path")).isin(*SCRIPT_LANGUAGES), F.lit(False))
    lines = readable(own).select("repository", "path", script.alias("script"), F.posexplode(F.split("content", LINE_ENDS)).alias("at", "text"))
    # dotted names have dots, others none
    tokens = lambda script: F.concat(names_in(F.col("text"), script), chains_in(F.col("text"), script))
    held = lines.select("repository", "path", (F.col("at") + 1).alias("line"), F.explode(F.when(F.col("script"), tokens(True)).otherwise(tokens(False))).alias("token"))
    named = held.join(names, ["repository", "token"]).groupBy("repository", "path", F.col("identifier").alias("value")).agg(F.min("line").alias("line"))
    runs = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(f"[a-z0-9]{{{LEAST_WORD},}}"), F.lit(0)))
    # all of a run's grams in one pass
    within = F.regexp_extract_all("run", F.lit(f"(?=([a-z0-9]{{{GRAM}}}))"), F.lit(1))
    spoken = readable(own).select("repository", "path", F.explode(runs).alias("run")).select("repository", "path", "run", F.explode(within).alias("gram"))
    spoken = spoken.join(words, ["repository", "gram"]).where(F.contains("run", F.col("needle"))).select("repository", "path", F.col("needle").alias("value")).distinct()
    return named.unionByName(spoken.withColumn("line", F.lit(None).cast("int")))


def _asked_words(issues: DataFrame) -> DataFrame:
    return issues.select("issue_id", "repository", F.explode(F.array_distinct("content_terms")).alias("needle")).where(F.length("needle") >= LEAST_WORD)


def content_hits(issues: DataFrame, files: DataFrame) -> DataFrame:
    """issue_id, path, identifiers, words, line of the files with either; arrays may be empty, line is null without identifiers. The issues come in when a file's rows are together."""
    names = asked_names(issues).select("repository", F.col("identifier").alias("value"), F.lit(True).alias("name"), "issue_id")
    words = _asked_words(issues).select("repository", F.col("needle").alias("value"), F.lit(False).alias("name"), "issue_id")
    by_value = names.unionByName(words).groupBy("repository", "value", "name").agg(F.collect_set("issue_id").alias("issues"))
    both = spread(found(issues, files).withColumn("name", F.col("line").isNotNull()), "path").join(small(by_value, "issues", FEW), ["repository", "value", "name"])
    each = both.select("path", "value", "line", F.explode("issues").alias("issue_id"))
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("value"))))
    return each.groupBy("path", "issue_id").agg(of(F.col("line").isNotNull()).alias("identifiers"), of(F.col("line").isNull()).alias("words"), F.min("line").alias("line")).select("issue_id", "path", "identifiers", "words", "line")
