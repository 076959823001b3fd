"""Workflow runs: a versioned run table with guarded transitions, append-only traces and snapshots, retries, and checks of model answers."""

from __future__ import annotations

import os
import secrets
import time
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "run_id string, status string, payload string, decision string, notes string, created_at timestamp, updated_at timestamp, version long"
TRACES = "run_id string, id long, node_name string, attempt int, status string, elapsed_ms double, detail string, started_at timestamp"
SNAPSHOTS = "run_id string, id long, node_name string, payload string, created_at timestamp"


def latest(versions: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("updated_at", "version")) -> DataFrame:
    """The last version of each key; created_at is that of the first."""
    whole = Window.partitionBy(key)
    place = F.row_number().over(whole.orderBy(*[F.desc(c) for c in order]))
    return versions.withColumns({"_n": place, "created_at": F.min("created_at").over(whole)}).where("_n = 1").drop("_n")


class RunStore:
    """Runs, traces and snapshots as Parquet tables in one folder. Writes append; reads take the last version of a run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, schema: str, rows: list[dict]) -> None:
        names = [x.split()[0] for x in schema.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def save_run(self, run_id: str, status: str, payload: str, now, decision: str | None = None, notes: str | None = None) -> None:
        """Append a version. It depends on no read, so writers need not wait for each other: its number is the time with random last bits, and created_at is that of the first version."""
        version = time.time_ns() >> 12 << 12 | secrets.randbits(12)
        self._append("runs", RUNS, [{"run_id": run_id, "status": status, "payload": payload, "decision": decision, "notes": notes, "created_at": now, "updated_at": now, "version": version}])

    def run(self, run_id: str):
        row = latest(self._table("runs", RUNS).where(F.col("run_id") == run_id)).first()
        if row is None:
            raise KeyError(run_id)
        return row

    def claim(self, run_id: str, version: int) -> bool:
        """Claim the transition away from a version of a run: True for one caller alone. The claim is a file that is created only if it isn't there, which HDFS does in one step, and POSIX systems where they are asked for it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{quote(run_id, safe='')}/{version}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(path.getParent())
        try:
            if path.toUri().getScheme() in (None, "file"):
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            else:
                files.create(path, False).close()
        except FileExistsError:
            return False
        except Py4JJavaError as failure:
            if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
                return False
            raise
        return True

    def review(self, run_id: str, decision: str, notes: str, now) -> None:
        """Decide on a run that awaits review. Of several reviewers who all read the same version one claims it; the others fail, and so does a review of what has been decided since."""
        row = self.run(run_id)
        if row["status"] != "awaiting_review":
            raise ValueError(f"run {run_id} is {row['status']}")
        if not self.claim(run_id, row["version"]):
            raise ValueError(f"run {run_id} has been reviewed by someone else")
        self.save_run(run_id, decision, row["payload"], now, decision, notes)

    def append_trace(self, **row) -> None:
        self.append_traces([row])

    def append_traces(self, rows: list[dict]) -> None:
        """Many traces in one job and one file."""
        self._append("traces", TRACES, rows)

    def save_snapshot(self, **row) -> None:
        self._append("snapshots", SNAPSHOTS, [row])

    def traces(self, run_id: str) -> DataFrame:
        return self._table("traces", TRACES).where(F.col("run_id") == run_id).orderBy("id")

    def snapshots(self, run_id: str) -> DataFrame:
        return self._table("snapshots", SNAPSHOTS).where(F.col("run_id") == run_id).orderBy("id")


class Retryable(Exception):
    """A failure that may pass; wait is how many seconds to leave at least (None: no wait is needed)."""

    def __init__(self, message: str, wait: float | None = 0.0):
        super().__init__(message)
        self.wait = wait


def with_retries(action: Callable, retries: int = 2, trace: Callable | None = None, sleep: Callable = time.sleep, most: float = 30.0):
    """action() with up to retries repeats after Retryable failures, 1, 2, 4 ... seconds apart (most at most, the failure's wait at least)."""
    for attempt in range(1, retries + 2):
        began = time.monotonic()
        try:
            out = action()
        except Exception as failure:
            if trace:
                trace(attempt, "failed", time.monotonic() - began, str(failure))
            if not isinstance(failure, Retryable) or attempt > retries:
                raise
            if failure.wait is not None:
                sleep(max(min(most, 2.0 ** (attempt - 1)), failure.wait))
        else:
            if trace:
                trace(attempt, "completed", time.monotonic() - began, summary(out))
            return out


def summary(value) -> str:
    if isinstance(value, DataFrame):
        return "DataFrame(" + ", ".join(value.columns) + ")"
    if isinstance(value, (list, tuple, set, dict)):
        return f"{len(value)} items"
    return type(value).__name__


def run_workflow(store: RunStore, run_id: str, nodes: list[tuple[str, Callable]], state: dict, clock: Callable, retries: int = 2, sleep: Callable = time.sleep) -> dict:
    """Run named nodes (state -> dict of updates) one after the other; every attempt is traced, every finished node has a snapshot. The run ends as
    awaiting_review, or failed, and then the failure is raised again."""
    import json

    store.save_run(run_id, "running", json.dumps(sorted(state)), clock())
    n = 0
    try:
        for name, node in nodes:

            def trace(attempt, status, seconds, detail, name=name):
                nonlocal n
                n += 1
                store.append_trace(run_id=run_id, id=n, node_name=name, attempt=attempt, status=status, elapsed_ms=1000 * seconds, detail=detail, started_at=clock())

            state = {**state, **with_retries(lambda: node(state), retries, trace, sleep)}
            store.save_snapshot(run_id=run_id, id=n, node_name=name, payload=json.dumps({k: summary(v) for k, v in state.items()}), created_at=clock())
    except Exception as failure:
        store.save_run(run_id, "failed", str(failure), clock())
        raise
    store.save_run(run_id, "awaiting_review", json.dumps(sorted(state)), clock())
    return state


def trace_summary(traces: DataFrame) -> DataFrame:
    """For each run and node: attempts, failures, whether it completed, and time in all."""
    return traces.groupBy("run_id", "node_name").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), F.bool_or(F.col("status") == "completed").alias("completed"), F.round(F.sum("elapsed_ms"), 3).alias("elapsed_ms"))


def coverage(observed: Column, valid: Column) -> Column:
    """Category of an answer's evidence ids, or null: each valid id observed just once, none unknown."""
    same = (F.size(F.array_except(observed, valid)) == 0) & (F.size(F.array_except(valid, observed)) == 0) & (F.size(observed) == F.size(valid))
    return F.when(~same, "evidence_observation_coverage")


def contradictions(observations: Column) -> Column:
    """'id: text' of observations (array of struct evidence_id, observation, alignment) against the issue."""
    return F.transform(F.filter(observations, lambda o: o.alignment == "contradicts_issue"), lambda o: F.concat_ws(": ", o.evidence_id, o.observation))


def component(file: Column, symbol: Column) -> Column:
    return F.when(symbol.isNotNull() & (symbol != ""), F.concat_ws("::", file, symbol)).otherwise(F.coalesce(file, F.lit("unknown")))


ANSWER = "summary string, issue_type string, observations array<struct<evidence_id:string,observation:string,alignment:string>>, hypothesis struct<statement:string,evidence_ids:array<string>,missing_evidence:array<string>>"


def parse_answer(payload: Column) -> Column:
    """struct(answer, problem): from_json with problem for text that isn't JSON, for unknown and for missing keys."""
    answer = F.from_json(payload, ANSWER, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(payload)
    known = F.array(*[F.lit(k) for k in ("summary", "issue_type", "observations", "hypothesis")])
    problem = F.when(keys.isNull(), "not a JSON object").when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_except(keys, known)), ","))).when(F.size(F.array_except(known, keys)) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(F.array_except(known, keys)), ",")))
    return F.struct(answer.alias("answer"), problem.alias("problem"))


# Classes of problems of an answer, and how many places of them are told.
INVALID, UNKNOWN, MISSING, MISTYPED, TOLD = "invalid_json", "extra_forbidden", "missing", "type_error", 5
_KINDS = {"string": "STRING", "bigint": "BIGINT", "int": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def schema_problems(rows: DataFrame, schema: T.StructType, payload: str = "payload") -> DataFrame:
    """id, path, problem: where the JSON of rows (id, payload) departs from a schema: keys that it does not have, keys that are missing, values of another type (null is one unless the field is
    nullable). Paths are dotted, with places of arrays as numbers; the whole has the path ''.

    The text is parsed once to a VARIANT and walked as deep as the schema is: each of its nodes is a table of values, taken from those of the node above.
    """
    at = rows.select("id", F.try_parse_json(F.col(payload)).alias("v"))
    out = [at.where("v IS NULL").select("id", F.lit("").alias("path"), F.lit(INVALID).alias("problem"))]
    problem = lambda df, what, path="path": df.select("id", F.col(path).alias("path"), F.lit(what).alias("problem"))

    def walk(values: DataFrame, kind: T.DataType) -> None:
        """values: id, path, v (a value that is there) and s, its type."""
        whole = lambda prefix: F.col("s").startswith(prefix)
        if isinstance(kind, T.StructType):
            out.append(problem(values.where(~whole("OBJECT")), MISTYPED))
            objects = values.where(whole("OBJECT"))
            keys = objects.withColumn("keys", F.json_object_keys(F.to_json("v")))
            names = F.array(*[F.lit(f.name) for f in kind.fields])
            dotted = lambda c: F.when(F.col("path") == "", c).otherwise(F.concat_ws(".", "path", c))
            for what, these in ((UNKNOWN, F.array_except("keys", names)), (MISSING, F.array_except(names, F.col("keys")))):
                out.append(problem(keys.withColumn("k", F.explode(these)).withColumn("path", dotted(F.col("k"))), what))
            for field in kind.fields:
                own = keys.where(F.array_contains("keys", field.name)).select("id", dotted(F.lit(field.name)).alias("path"), F.try_variant_get("v", F.lit(f"$['{field.name}']"), "variant").alias("v")).withColumn("s", F.schema_of_variant("v"))
                walk(own.where("s <> 'VOID'") if field.nullable else own, field.dataType)
        elif isinstance(kind, T.ArrayType):
            out.append(problem(values.where(~whole("ARRAY")), MISTYPED))
            items = values.where(whole("ARRAY")).withColumn("x", F.explode(F.expr("transform(try_variant_get(v, '$', 'array<variant>'), (x, i) -> struct(x AS v, i AS i))")))
            walk(items.select("id", F.concat_ws(".", "path", F.col("x.i").cast("string")).alias("path"), F.col("x.v").alias("v")).withColumn("s", F.schema_of_variant("v")), kind.elementType)
        else:
            wanted = _KINDS[kind.simpleString()]
            fits = whole("DOUBLE") | whole("DECIMAL") | whole("BIGINT") if wanted == "DOUBLE" else whole(wanted)
            out.append(problem(values.where(~fits), MISTYPED))

    walk(at.where("v IS NOT NULL").select("id", F.lit("").alias("path"), "v", F.schema_of_variant("v").alias("s")), schema)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def validation_detail(rows: DataFrame, schema: T.StructType, payload: str = "payload") -> DataFrame:
    """id, problems (how many), classes and fields of the answers that depart from the schema: the classes sorted, the first TOLD places in order."""
    found = schema_problems(rows, schema, payload)
    return found.groupBy("id").agg(F.count("*").alias("problems"), F.array_sort(F.collect_set("problem")).alias("classes"), F.slice(F.array_sort(F.collect_set("path")), 1, TOLD).alias("fields"))
