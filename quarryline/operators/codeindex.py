"""A relational index of source files: languages, symbols, imports, call edges, frameworks and a summary.

Parsing is one Python pass over files (path, content), a row at a time; everything across files is joins. Tables are keyed by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X
from quarryline.operators.pyparse import parse
from quarryline.operators.tables import spread, stored

# Folders that aren't indexed, files that start a program, imports that tell a framework.
SKIPPED = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache")
RUNTIME_FILES = ("pyproject.toml", "requirements.txt", "package.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "go.mod", "Cargo.toml")
ENTRYPOINTS = ("main.py", "app.py", "server.py", "manage.py", "cli.py", "index.ts", "index.js")
FRAMEWORKS = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django", "sqlalchemy": "SQLAlchemy", "typer": "Typer", "celery": "Celery", "langgraph": "LangGraph"}

_SYMBOL = T.StructType([T.StructField("name", T.StringType()), T.StructField("qualified_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("docstring", T.StringType())])
_BINDING = T.StructType([T.StructField(c, T.StringType()) for c in ("local_name", "target", "symbol")])
_USE = T.StructType([*[T.StructField(c, T.StringType()) for c in ("kind", "caller", "local_name", "target", "symbol")], T.StructField("function_local", T.BooleanType())])
_EXTERNAL = T.StructType([T.StructField(c, T.StringType()) for c in ("caller", "target")])
PARSED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("symbols", T.ArrayType(_SYMBOL)),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("bindings", T.ArrayType(_BINDING)),
    T.StructField("uses", T.ArrayType(_USE)),
    T.StructField("external", T.ArrayType(_EXTERNAL)),
    T.StructField("calls", T.ArrayType(T.StringType())),
    T.StructField("names", T.ArrayType(T.StringType())),
])


def visible(files: DataFrame) -> DataFrame:
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def parse_python(files: DataFrame) -> DataFrame:
    """PARSED for the Python files among files (path, content)."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = parse(content or "", path)
                named = lambda kind, x: [dict(zip(kind.names, r)) for r in x]
                rows.append({"path": path, **got, "symbols": named(_SYMBOL, got["symbols"]), "bindings": named(_BINDING, got["bindings"]), "uses": named(_USE, got["uses"]), "external": named(_EXTERNAL, got["external"])})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(PARSED))

    return visible(files).where("path LIKE '%.py'").select("path", "content").mapInArrow(run, PARSED)


def children(parsed: DataFrame, column: str) -> DataFrame:
    """path and the fields of an array column, one row an entry; ord keeps its order."""
    rows = parsed.select("path", F.posexplode(column).alias("ord", "x"))
    return rows.select("path", "ord", "x.*") if isinstance(parsed.schema[column].dataType.elementType, T.StructType) else rows.withColumnRenamed("x", "value")


def source_roots(files: DataFrame) -> DataFrame:
    """root: src and lib where they hold Python files and aren't packages themselves."""
    first = F.regexp_extract("path", "^(src|lib)/", 1)
    held = files.where("path LIKE '%.py'").withColumn("root", first).where("root <> ''")
    return held.groupBy("root").agg(F.bool_or(F.col("path") == F.concat("root", F.lit("/__init__.py"))).alias("package")).where("NOT package").select("root")


def modules(files: DataFrame) -> DataFrame:
    """path, module and package of Python files."""
    roots = source_roots(files)
    rows = visible(files).where("path LIKE '%.py'").select("path", F.regexp_extract("path", "^(src|lib)/", 1).alias("root"))
    marked = rows.join(roots.withColumn("layout", F.lit(True)), "root", "left").withColumn("roots", F.when(F.col("layout"), F.array("root")).otherwise(F.array().cast("array<string>")))
    named = marked.withColumn("module", X.python_module(F.col("path"), F.col("roots")))
    return named.select("path", "module", F.when(F.col("path").rlike(r"(?:^|/)__init__\.py$"), F.col("module")).otherwise(F.regexp_replace("module", r"\.?[^.]*$", "")).alias("package"))


def absolute(imported: Column, package: Column) -> Column:
    """The dotted name that an import with leading dots means in a package; null if it leaves the top."""
    level = F.length(F.regexp_extract(imported, r"^(\.*)", 1))
    rest = F.regexp_replace(imported, r"^\.+", "")
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))
    kept = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - level + 1))
    return F.when(level == 0, rest).when(level - 1 <= F.size(parts), F.array_join(F.filter(F.concat(kept, F.array(rest)), lambda x: x != ""), "."))


def prefixes(name: Column) -> Column:
    """struct(prefix, depth, next): all leading parts of a dotted name, and the part after them."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("prefix"), n.alias("depth"), F.get(parts, n).alias("next")))


def resolve_imports(imports: DataFrame, modules_: DataFrame) -> DataFrame:
    """imports (path, target and more) with target_path and imported_symbol: the module with the longest prefix of the name, and the name's next part. A module of several files gives several rows (paths counts them)."""
    own = [c for c in imports.columns if c != "path"]
    # "merge": a list of names made in a query looks short to the optimizer however many files there are, so that it would be broadcast
    modules_ = modules_.hint("merge")
    keyed = imports.withColumn("_key", F.xxhash64("path", *own)).join(modules_.select("path", "package"), "path").withColumn("_name", absolute(F.col("target"), F.col("package"))).where("_name <> ''")
    tried = keyed.select("path", *own, "_key", F.explode(prefixes(F.col("_name"))).alias("p")).select("path", *own, "_key", "p.*")
    met = tried.join(modules_.where("module <> ''").select(F.col("module").alias("prefix"), F.col("path").alias("target_path")), "prefix")
    deepest = Window.partitionBy("_key", "path", *own)
    longest = met.withColumn("_d", F.max("depth").over(deepest)).where("depth = _d").withColumn("paths", F.count("*").over(deepest))
    return longest.select("path", *own, "target_path", F.col("next").alias("imported_symbol"), "paths")


def resolved_uses(parsed: DataFrame, modules_: DataFrame) -> DataFrame:
    """path, kind, caller, local_name, target_file, target_symbol, function_local: uses of this file's functions, and imported ones where one file and one symbol of it can be meant."""
    uses = children(parsed, "uses").drop("ord")
    own = uses.where("target = ''").select("path", "kind", "caller", "local_name", F.col("path").alias("target_file"), F.col("symbol").alias("target_symbol"), "function_local")
    symbols = children(parsed, "symbols").groupBy(F.col("path").alias("target_path"), F.col("qualified_name").alias("imported_symbol")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    found = resolve_imports(uses.where("target <> ''"), modules_).where("paths = 1 AND imported_symbol = symbol").join(symbols, ["target_path", "imported_symbol"])
    return own.unionByName(found.select("path", "kind", "caller", "local_name", F.col("target_path").alias("target_file"), F.col("imported_symbol").alias("target_symbol"), "function_local")).distinct()


def local_imports(parsed: DataFrame, modules_: DataFrame) -> DataFrame:
    """path, target_path, symbols (sorted): files of the repository that a file imports."""
    rows = children(parsed, "imports").select("path", F.col("value").alias("target"))
    found = resolve_imports(rows, modules_).where("target_path <> path")
    return found.groupBy("path", "target_path").agg(F.array_sort(F.collect_set("imported_symbol")).alias("symbols"))


def bound_symbols(parsed: DataFrame, modules_: DataFrame) -> DataFrame:
    """path, target_path, symbol: names that a file's own from-imports bind for sure, with the one file that has them."""
    rows = children(parsed, "bindings").select("path", "target", "symbol").distinct()
    return resolve_imports(rows, modules_).where("paths = 1 AND imported_symbol = symbol AND target_path <> path").select("path", "target_path", "symbol").distinct()


def frameworks(parsed: DataFrame) -> DataFrame:
    """framework, files: how many files import each known framework."""
    first = F.regexp_extract("value", "^([A-Za-z_0-9]+)", 1)
    names = F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv])
    return children(parsed, "imports").select("path", names[first].alias("framework")).where("framework IS NOT NULL").groupBy("framework").agg(F.count_distinct("path").alias("files"))


def test_directories(files: DataFrame) -> DataFrame:
    """Distinct folders named test or tests, with what leads to them."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return visible(files).select(F.explode(F.slice(folders, F.lit(1), F.size(parts) - 1)).alias("directory")).where("directory RLIKE '(?:^|/)tests?$'").distinct()


def named_files(files: DataFrame, names: tuple[str, ...] = RUNTIME_FILES) -> DataFrame:
    return visible(files).where(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path")


def called_names(uses: DataFrame) -> DataFrame:
    """path, name_calls (local names that are called) and symbol_calls (callers with the symbols that they call), all sorted, from resolved_uses()."""
    calls = uses.where("kind = 'call'")
    names = calls.groupBy("path").agg(F.array_sort(F.collect_set("local_name")).alias("name_calls"))
    by_caller = calls.where("caller IS NOT NULL").groupBy("path", "caller").agg(F.array_sort(F.collect_set("target_symbol")).alias("symbols"))
    return names.join(by_caller.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("caller", "symbols"))).alias("symbol_calls")), "path", "left")


def summary(files: DataFrame) -> DataFrame:
    """place, language, files: languages by their files, the one whose first path comes first where there are as many."""
    rows = visible(files).select("path", X.language(F.col("path")).alias("language")).where("language IS NOT NULL")
    counted = rows.groupBy("language").agg(F.count("*").alias("files"), F.min("path").alias("first"))
    # one row for each language
    return counted.select(F.row_number().over(Window.orderBy(F.desc("files"), "first")).cast("long").alias("place"), "language", "files")


def language_counts(files: DataFrame) -> DataFrame:
    return visible(files).select(X.language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"))


def repository_map(files: DataFrame) -> dict[str, DataFrame]:
    """The index of files (path, content): files, symbols, uses, external calls, imports, frameworks, languages, tests, runtime files and entry points. Files are parsed once, to a stored table that all others read."""
    parsed, own = stored(parse_python(spread(files.select("path", "content"), "path")), "parsed"), stored(modules(files), "modules")
    return {
        "files": visible(files).select("path", X.language(F.col("path")).alias("language"), (F.lower(F.element_at(F.split("path", "/"), -1)).contains("test") | F.col("path").rlike("(?:^|/)tests?/")).alias("test_file")).where("language IS NOT NULL"),
        "symbols": children(parsed, "symbols"),
        "uses": resolved_uses(parsed, own),
        "external": children(parsed, "external").drop("ord"),
        "imports": local_imports(parsed, own),
        "frameworks": frameworks(parsed),
        "languages": language_counts(files),
        "test_directories": test_directories(files),
        "runtime_files": named_files(files),
        "entrypoints": named_files(files, ENTRYPOINTS),
        "modules": own,
        "bound": bound_symbols(parsed, own),
        "names": children(parsed, "names"),
        "imported": children(parsed, "imports"),
    }
