"""Column functions on terms, identifiers, paths, urls and model answers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell nothing about code.
GENERIC_TERMS = (
    "an", "and", "are", "as", "at", "be", "been", "by", "code", "com", "could", "def", "details", "example", "for", "github", "https", "import", "issue",
    "error", "fails", "failure", "problem", "when", "with", "from", "the", "this", "that", "have", "does", "has", "if", "in", "into", "is", "it", "its", "more", "none", "not", "of", "on", "only",
    "or", "print", "py", "python", "return", "should", "so", "than", "then", "there", "to", "using", "was", "were", "will", "would",
)
SOURCE_SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "c", "cc", "cpp")
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".go": "Go", ".rs": "Rust", ".c": "C", ".cc": "C++", ".cpp": "C++"}
EXCLUDED_PARTS = (".github", "benchmark", "benchmarks", "changelog", "changes", "doc", "docs", "example", "examples", "generated", "news", "script", "scripts", "test", "tests", "vendor", "vendored")
EXCLUDED_PREFIXES = ("benchmark", "doc", "example", "test")
QUOTES = "`'\"()[]{}:,"


def _split_camel(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def ordered_terms(value: Column) -> Column:
    """Lower-cased words of two characters or more, CamelCase split, generic ones left out, in order."""
    words = F.regexp_extract_all(F.lower(_split_camel(F.translate(value, "\\", "/"))), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*GENERIC_TERMS))


def terms(value: Column) -> Column:
    """Distinct ordered_terms, sorted."""
    return F.array_sort(F.array_distinct(ordered_terms(value)))


def identifier_variants(value: Column) -> Column:
    """Lower-cased spellings of an identifier: itself, its last part, its words joined by _ and joined; three characters or more."""
    low = F.btrim(F.lower(value), F.lit(QUOTES))
    parts = ordered_terms(value)
    some = F.size(parts) > 0
    made = F.array(low, F.when(low.contains("."), F.substring_index(low, ".", -1)), F.when(some, F.array_join(parts, "_")), F.when(some, F.array_join(parts, "")))
    return F.array_sort(F.array_distinct(F.filter(made, lambda v: F.coalesce(F.length(v) >= 3, F.lit(False)))))


def compact_variants(value: Column) -> Column:
    """Letters and digits alone, and the singular; four characters or more."""
    flat = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    single = F.when(flat.endswith("s") & (F.length(flat) > 4), F.expr("1").cast("int"))
    made = F.array(flat, F.when(single.isNotNull(), F.left(flat, F.length(flat) - 1)))
    return F.array_sort(F.array_distinct(F.filter(made, lambda v: F.coalesce(F.length(v) >= 4, F.lit(False)))))


def identifiers(text: Column) -> Column:
    """Identifiers with _, a dot or an inner capital, and code spans that are one."""
    word = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\b"
    found = F.filter(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: w.contains("_") | w.contains(".") | F.substring(w, 2, 1 << 30).rlike("[A-Z]"))
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!`)`([^`\n]{1,120})`(?!`)"), F.lit(1)), lambda s: F.btrim(s))
    return F.array_sort(F.array_distinct(F.concat(found, F.filter(spans, lambda s: s.rlike(rf"^(?:{word})$")))))


def identifier_mentions(text: Column) -> Column:
    """All identifiers outside fenced code in order, then the last parts of dotted calls."""
    plain = F.regexp_replace(text, r"(?s)```[^\n]*\n.*?```", " ")
    word = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\b"
    called = F.regexp_extract_all(plain, F.lit(r"\b((?:[A-Za-z_][A-Za-z0-9_]*\.)*[A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    last = F.transform(F.filter(called, lambda w: w.contains(".")), lambda w: F.substring_index(w, ".", -1))
    return F.concat(F.regexp_extract_all(plain, F.lit(word), F.lit(0)), last)


def source_snippets(text: Column) -> Column:
    """Up to four fenced blocks of 3 to 12 non-empty lines with 60 to 2000 characters: their trimmed lines without empty ones at either end."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    lines = F.transform(blocks, lambda b: F.split(F.regexp_replace(F.regexp_replace(b, r"[^\S\n]*\n[^\S\n]*", "\n"), r"^\s+|\s+$", ""), "\n"))
    full = lambda x: F.filter(x, lambda line: line != "")
    chars = lambda x: F.aggregate(full(x), F.lit(0), lambda a, line: a + F.length(line))
    return F.slice(F.filter(lines, lambda x: F.size(full(x)).between(3, 12) & chars(x).between(60, 2000)), 1, 4)


def path_references(text: Column) -> Column:
    """Distinct paths of source files in a text, with / and without quotes around."""
    pattern = rf"(?i)(?<![A-Za-z0-9_.-])(?:[A-Za-z]:)?[A-Za-z0-9_.~:/\\-]*[A-Za-z0-9_.-]+\.(?:{'|'.join(SOURCE_SUFFIXES)})(?![A-Za-z0-9_])"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.btrim(F.translate(p, "\\", "/"), F.lit(QUOTES)))))


def semantic_term(term: Column) -> Column:
    """A light stem; the first ending that fits goes, then a final e."""
    n, cut = F.length(term), lambda k: F.left(term, F.length(term) - k)
    stem = (
        F.when((n > 5) & term.endswith("ized"), cut(4))
        .when((n > 5) & term.endswith("ing"), cut(3))
        .when((n > 4) & term.endswith("ed"), cut(2))
        .when((n > 5) & term.rlike("(?:ches|ses|shes|xes|zes)$"), cut(2))
        .when((n > 3) & term.endswith("s"), cut(1))
        .otherwise(term)
    )
    return F.when((F.length(stem) > 4) & stem.endswith("e"), F.left(stem, F.length(stem) - 1)).otherwise(stem)


def semantic_sequence(value: Column) -> Column:
    """Stems of all words in order, generic ones too."""
    return F.transform(F.regexp_extract_all(F.lower(_split_camel(value)), F.lit("[a-z][a-z0-9]+"), F.lit(0)), semantic_term)


def bigrams(words: Column) -> Column:
    """Neighbours in an array as 'a b'."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def normalize_path(path: Column) -> Column:
    """Lower-cased with /, without / at the end or any of ./ at the start."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(path), "\\", "/"), "/+$", ""), r"^[./]+", "")


def path_suffixes(path: Column) -> Column:
    """The path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_match(a: Column, b: Column) -> Column:
    """One of two normalised paths ends with the other; no boundary is asked for."""
    return a.endswith(b) | b.endswith(a)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    return low.rlike("(?:^|/)(?:t|test|testing|tests)/") | (name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py")


def excluded_path_reason(path: Column) -> Column:
    """Why a changed file can't be a target, or null."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    folder = low.rlike(rf"(?:^|/)(?:(?:{'|'.join(p.replace('.', '[.]') for p in EXCLUDED_PARTS)})|(?:{'|'.join(EXCLUDED_PREFIXES)})[^/]*)/")
    suffix = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    return F.when(folder, "test, documentation, example, generated, or vendored path").when((name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py"), "test file").when(~suffix.isin(*LANGUAGES), "unsupported source suffix")


def language(path: Column) -> Column:
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def python_module(path: Column, roots: Column) -> Column:
    """Dotted module of a .py path; a first part in roots (array) is left out, __init__ stands for its package."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    inner = F.when(F.array_contains(roots, F.get(parts, F.lit(0))) & (F.size(parts) > 1), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.array_join(F.when(F.element_at(inner, -1) == "__init__", F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(inner), ".")


def closing_reference(text: Column, number: Column) -> Column:
    """Whether a text closes, fixes or resolves #number or the issue's url."""
    target = F.concat(F.lit(r"(?i)(?:^|[^a-z0-9_])(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s*(?:#|https://github\.com/[^/\s]+/[^/\s]+/issues/)"), number.cast("string"), F.lit(r"(?:[^0-9A-Za-z_]|$)"))
    return F.regexp_like(text, target)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.98), 0.2 + score / 30), 2)


def rank_line(answer: Column, known: Column, most: int = 3) -> Column:
    """Ids of an answer's only 'RANK: a, b' line, distinct; null if there isn't just one line, there are over most ids or one isn't known."""
    lines = F.regexp_extract_all(answer, F.lit(r"(?m)^\s*RANK:\s*([A-Za-z0-9_-]+(?:\s*,\s*[A-Za-z0-9_-]+)*)\s*$"), F.lit(1))
    ids = F.array_distinct(F.split(F.get(lines, F.lit(0)), r"\s*,\s*"))
    return F.when((F.size(lines) == 1) & (F.size(ids) <= most) & (F.size(F.array_except(ids, known)) == 0), ids)


def parse_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def api_repository(url: Column) -> Column:
    """owner/name after the first /repos/ of an address, or null; either may be empty."""
    parts = F.split(F.get(F.split(url, "/repos/", 2), F.lit(1)), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def pull_number(url: Column) -> Column:
    """The number after /pull/ or /pulls/ in an address, or null."""
    return F.regexp_extract(url, r"/(?:pull|pulls)/([0-9]+)(?:$|[/?#])", 1).try_cast("long")
