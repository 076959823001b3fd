"""A resumable triage run: the engine's operators as nodes, whose tables are stored so that a run that was killed goes on after its last finished node."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import signals as G
from quarryline.operators import codeindex, evidence, locate, scoring, similarity
from quarryline.operators.runs import RunStore, run_workflow

Node = tuple[str, Callable[[dict], dict]]
STATES = "run_id string, node_name string, payload string"


def durable(store: RunStore, run_id: str, nodes: list[Node]) -> list[Node]:
    """The nodes, each of which stores what it adds to the state: tables as Parquet, other values as JSON. A node of this run that has finished before is not run again; its values are read.

    A node counts as finished once its row in the store's states is committed, which is written after all its tables; what an attempt wrote that didn't come to that is never read.
    """
    spark, folder = store.spark, f"{store.folder}/tables/{quote(run_id, safe='')}"
    finished = {r.node_name: json.loads(r.payload) for r in store._table("states", STATES).where(F.col("run_id") == run_id).collect()}

    def loaded(kept: dict) -> dict:
        return {k: spark.read.parquet(v["table"]) if "table" in v else v["value"] for k, v in kept.items()}

    def wrapped(name: str, node: Callable[[dict], dict]) -> Callable[[dict], dict]:
        def run(state: dict) -> dict:
            if name not in finished:
                kept, place = {}, f"{folder}/{quote(name, safe='')}/{uuid.uuid4().hex}"
                for key, value in node(state).items():
                    if isinstance(value, DataFrame):
                        value.write.parquet(f"{place}/{key}")
                        kept[key] = {"table": f"{place}/{key}"}
                    else:
                        kept[key] = {"value": value}
                store._append("states", STATES, [{"run_id": run_id, "node_name": name, "payload": json.dumps(kept)}])
                finished[name] = kept
            return loaded(finished[name])

        return run

    return [(name, wrapped(name, node)) for name, node in nodes]


#: Tables of the index that location reads.
INDEX = ("files", "symbols", "uses", "external", "imports", "bound", "names", "imported", "languages", "runtime_files")


def triage_nodes(now: str, chosen: int = 3, limit: int = 20, answer: Callable[[dict], dict] | None = None) -> list[Node]:
    """Nodes from issues (number, title, body, labels, comments_count, created_at, updated_at, ord; repository) and files (repository, path, content): rank, route, index, investigate, hypotheses, evidence and, with answer, the model's node before review.

    answer(state) stands for a model: it gets the state with evidence and gives JSON values or tables.
    """

    def rank(state: dict) -> dict:
        return {"ranked": scoring.rank_issues(state["issues"], now, degrees=similarity.duplicate_degrees(state["issues"]))}

    def route(state: dict) -> dict:
        return {"chosen": state["issues"].join(scoring.top_k(state["ranked"], chosen).select("number"), "number", "left_semi")}

    def index(state: dict) -> dict:
        made = codeindex.repository_map(state["files"].select("path", "content"))
        return {f"index_{k}": made[k] for k in INDEX}

    def investigate(state: dict) -> dict:
        signals = G.issue_signals(state["chosen"].select(F.col("number").alias("issue_id"), "repository", "title", "body", "labels"))
        return {"candidates": locate.locate(signals, state["files"], {k: state[f"index_{k}"] for k in INDEX}, limit)}

    def hypotheses(state: dict) -> dict:
        return {"hypotheses": locate.investigate(state["chosen"].select(F.col("number").alias("issue_id")), state["candidates"])}

    def collect(state: dict) -> dict:
        return {"evidence": evidence.collect_evidence(state["candidates"].select("issue_id", F.col("rank").cast("long").alias("rank"), "path", "lines"), state["files"].select("path", "content"))}

    def review(state: dict) -> dict:
        return {"awaiting": state["chosen"].count()}

    nodes = [("rank", rank), ("route", route), ("index", index), ("investigate", investigate), ("hypotheses", hypotheses), ("evidence", collect)]
    return [*nodes, *([("model", answer)] if answer else []), ("review", review)]


def triage(store: RunStore, run_id: str, issues: DataFrame, files: DataFrame, now: str, clock: Callable, **options) -> dict:
    """Run, or go on with, a triage; returns its state."""
    return run_workflow(store, run_id, durable(store, run_id, triage_nodes(now, **options)), {"issues": issues, "files": files}, clock)
