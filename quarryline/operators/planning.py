"""Choosing cases for review: options of a repository, a plan over all repositories, and the queue of primary and reserve cases.

Edges are reviewable candidates (repository, issue_number, pr_number, multi_file, candidate_id) with rank, their place among all of
them (0 is best). A case is an edge; no two cases share an issue or a pull request, and cases never cross repositories.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.audit import kuhn, maximum_matching
from quarryline.operators.tables import stored

Edge = tuple[int, int, bool, int, str]  # issue, pull request, several files, rank, id


def ranked(edges: DataFrame, order: list) -> DataFrame:
    """edges with rank, by a distributed sort: a row's place in its range after the rows of all ranges before it. The sorted line is stored before ranges are counted, so that a lost executor can't have it sorted into other ranges."""
    line = stored(edges.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "line")
    sizes = line.groupBy("_range").agg(F.count("*").alias("n"))
    # one row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    return line.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_at", "_before")


def matching_size(edges: Iterable[Edge]) -> int:
    pairs = [(e[0], e[1]) for e in edges]
    return len(kuhn(pairs, list(dict.fromkeys(i for i, _ in pairs))))


def _kernel(edges: list[Edge], most: int) -> list[Edge]:
    """Edges that a cheapest choice of at most `most` cases may need: with `most` cheaper ones of its sort at its issue, or at its pull request, an edge can be exchanged for one of those."""
    kept, used = [], {}
    for e in edges:
        ends = (("issue", e[0], e[2]), ("pull", e[1], e[2]))
        if all(used.get(x, 0) < most for x in ends):
            kept.append(e)
            for x in ends:
                used[x] = used.get(x, 0) + 1
    # a choice of the others blocks 2 * most * (most - 1) kept edges of a sort at most
    room, out = {True: 2 * most * (most - 1) + 1, False: 2 * most * (most - 1) + 1}, []
    for e in kept:
        if room[e[2]]:
            room[e[2]] -= 1
            out.append(e)
    return out


def options(edges: list[Edge], most: int, reserve: int) -> dict[tuple[int, int, int], tuple[int, tuple[str, ...]]]:
    """For (cases, multi-file cases, reserve capacity) of one repository the least sum of ranks and the ids that give it, without options that another one
    of as many cases and multi-file cases beats in cost and capacity: no plan needs those.

    The capacity is what a maximum matching of the edges that a choice leaves untouched still holds, at most reserve; each case that is added lowers that
    matching by one at least (else the case would enlarge it). So a choice is left where all that it can grow into costs more than known options of the capacity then possible. A case takes an issue and a pull
    request away, each of which lowers a matching by one at most; where the whole matching exceeds reserve by twice the cases, the capacity is
    reserve whatever is chosen, and a few edges are enough to choose from.
    """
    edges = sorted(edges, key=lambda e: e[3])
    ample = matching_size(edges) >= reserve + 2 * most
    pool = _kernel(edges, most) if ample else edges
    best: dict[tuple[int, int], dict[int, tuple[int, tuple[str, ...]]]] = {}
    # costs of the next cheapest edges of either sort from each place on
    after = {sort: [[e[3] for e in pool[at:] if e[2] == sort][:most] for at in range(len(pool) + 1)] for sort in (True, False)}

    def beaten(cases: int, multi: int, capacity: int, cost: int) -> bool:
        return any(c >= capacity and known[0] < cost for c, known in best.get((cases, multi), {}).items())

    def promising(at: int, cases: int, multi: int, left: int, cost: int) -> bool:
        for more in range(1, most - cases + 1):
            for several in range(more + 1):
                rest = after[True][at][:several] + after[False][at][: more - several]
                if len(rest) == more and not beaten(cases + more, multi + several, reserve if ample else min(reserve, left - more), cost + sum(rest)):
                    return True
        return False

    todo: list[tuple[int, tuple[Edge, ...], int, int]] = [(0, (), 0, 0)]
    while todo:
        at, chosen, multi, cost = todo.pop()
        issues, pulls = {c[0] for c in chosen}, {c[1] for c in chosen}
        left = reserve if ample else matching_size(e for e in edges if e[0] not in issues and e[1] not in pulls)
        capacity = min(reserve, left)
        if not beaten(len(chosen), multi, capacity, cost):
            known, value = best.setdefault((len(chosen), multi), {}), (cost, tuple(c[4] for c in chosen))
            known[capacity] = min(known.get(capacity, value), value)
        if len(chosen) == most or not promising(at, len(chosen), multi, left, cost):
            continue
        # the cheapest next edge is taken up first, so bounds are good early
        for k in range(len(pool) - 1, at - 1, -1):
            e = pool[k]
            if e[0] not in issues and e[1] not in pulls:
                todo.append((k + 1, (*chosen, e), multi + e[2], cost + e[3]))
    return {(*key, capacity): value for key, known in best.items() for capacity, value in known.items() if not any(c > capacity and o[0] < value[0] for c, o in known.items())}


def repository_options(edges: DataFrame, most: int = 5, reserve: int = 30) -> DataFrame:
    """repository, cases, multi, capacity, cost and ids (joined by commas) of every repository's options."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(group.issue_number.tolist(), group.pr_number.tolist(), group.multi_file.tolist(), group["rank"].tolist(), group.candidate_id.tolist()))
        return pd.DataFrame([(group.repository.iloc[0], *key, cost, ",".join(ids)) for key, (cost, ids) in sorted(options(rows, most, reserve).items())], columns=["repository", "cases", "multi", "capacity", "cost", "ids"])

    narrow = edges.select(F.lower("repository").alias("repository"), "issue_number", "pr_number", "multi_file", F.col("rank").cast("long").alias("rank"), "candidate_id")
    return narrow.groupBy("repository").applyInPandas(one, "repository string, cases long, multi long, capacity long, cost long, ids string")


#: A cost that no plan has.
NO_PLAN = np.iinfo(np.int64).max // 4


def _advanced(cost: np.ndarray, origin: np.ndarray, axis: int, step: int, open_ended: bool) -> tuple[np.ndarray, np.ndarray]:
    """Both moved step places up an axis; open-ended ones gather all that moves past their last place there, of which the cheapest counts."""
    cost, origin = np.moveaxis(cost, axis, 0), np.moveaxis(origin, axis, 0)
    out, at, n = np.full_like(cost, NO_PLAN), np.zeros_like(origin), len(cost)
    if step < n:
        out[step:], at[step:] = cost[: n - step], origin[: n - step]
    if open_ended:
        low = max(0, n - 1 - step)
        first = cost[low:].argmin(0)[None]
        out[-1], at[-1] = (np.take_along_axis(x[low:], first, 0)[0] for x in (cost, origin))
    return np.moveaxis(out, 0, axis), np.moveaxis(at, 0, axis)


def plan(by_repository: Iterable[tuple[str, list[tuple[int, int, int, int, str]]]], repositories: int, size: int, multi: int, reserve: int) -> tuple[int, tuple[str, ...]]:
    """The cheapest choice of one option (cases, multi, capacity, cost, ids) of each repository: size cases, at least multi of several files and reserve capacity in all; of equally cheap ones that of the earlier options.

    Min-plus sums over a dense table of least costs by cases, multi-file cases and capacity: an option moves the whole table, the two open-ended axes end at what is asked for, and the cell-wise least of the moved tables is the next one. For each
    repository two small numbers a cell remember the way back. If there are no more repositories than cases, each gives one at least.
    """
    shape = (size + 1, multi + 1, reserve + 1)
    cost = np.full(shape, NO_PLAN)
    cost[0, 0, 0] = 0
    cells, ways = np.arange(cost.size, dtype=np.int32).reshape(shape), []
    for _, choices in by_repository:
        best, option, before = np.full(shape, NO_PLAN), np.full(shape, -1, np.int16), np.zeros(shape, np.int32)
        for k, (cases, several, capacity, spent, _) in enumerate(choices):
            if cases == 0 and size >= repositories:
                continue
            moved, origin = cost, cells
            for axis, step in enumerate((cases, several, capacity)):
                moved, origin = _advanced(moved, origin, axis, step, axis > 0)
            better = (moved < NO_PLAN) & (moved + spent < best)
            best[better], option[better], before[better] = moved[better] + spent, k, origin[better]
        cost = best
        ways.append((option.ravel(), before.ravel(), [c[4] for c in choices]))
    cell = cells[-1, -1, -1]
    least = int(cost.ravel()[cell])
    if least >= NO_PLAN:
        raise ValueError(f"no plan has {size} cases with {multi} multi-file ones and {reserve} in reserve")
    chosen: list[tuple[str, ...]] = []
    for option, before, ids in reversed(ways):
        names = ids[option[cell]]
        chosen.append(tuple(names.split(",")) if names else ())
        cell = before[cell]
    return least, tuple(x for names in reversed(chosen) for x in names)


def select_primary(edges: DataFrame, size: int, multi: int, most: int = 5, reserve: int = 30) -> tuple[int, tuple[str, ...]]:
    """Cost and candidate ids of plan() over the options of all repositories, which are read one repository at a time."""
    from itertools import groupby

    rows = repository_options(edges, most, reserve).orderBy("repository", "cases", "multi", "capacity").persist()
    repositories = rows.select("repository").distinct().count()
    lines = ((k, [tuple(r)[1:] for r in own]) for k, own in groupby(rows.toLocalIterator(), key=lambda r: r.repository))
    try:
        return plan(lines, repositories, size, multi, reserve)
    finally:
        rows.unpersist()


def review_queue(edges: DataFrame, base_cases: int, base_multi: int, total: int = 200, reserve: int = 30, most: int = 5, share: float = 0.3) -> DataFrame:
    """review_order, priority, candidate_id and rank: the primary cases that bring base_cases to total, by rank, then the reserves.

    Fails where the edges can't give so many different cases, so many of several files (share of the total, less base_multi), or the reserve.
    """
    import math

    if total <= base_cases or reserve < 0 or most < 1 or not 0 <= share <= 1:
        raise ValueError("the targets don't fit the base manifest")
    size, multi = total - base_cases, max(0, math.ceil(total * share) - base_multi)
    keyed = edges.withColumn("repository", F.lower("repository")).persist()
    match = lambda rows: maximum_matching(rows.withColumn("place", F.col("rank")))
    try:
        for rows, wanted, what in ((keyed, size, "cases"), (keyed.where("multi_file"), multi, "multi-file cases")):
            if (found := match(rows).count()) < wanted:
                raise ValueError(f"only {found} different {what} are there, {wanted} are asked for")
        _, ids = select_primary(keyed, size, multi, most, reserve)
        spark = edges.sparkSession
        chosen = keyed.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "candidate_id string")), "candidate_id", "left_semi")
        # no more than a queue's worth of rows
        primary = chosen.select("candidate_id", "rank", "repository", "issue_number", "pr_number").collect()
        used = spark.createDataFrame([(r.repository, r.issue_number, r.pr_number) for r in primary], "repository string, issue_number long, pr_number long")
        left = keyed.join(F.broadcast(used.select("repository", "issue_number")), ["repository", "issue_number"], "left_anti").join(F.broadcast(used.select("repository", "pr_number")), ["repository", "pr_number"], "left_anti")
        spare = match(left).join(left, ["repository", "issue_number", "pr_number"]).orderBy("rank").limit(reserve).select("candidate_id", "rank").collect()
    finally:
        keyed.unpersist()
    if len(spare) < reserve:
        raise ValueError(f"only {len(spare)} different reserve cases remain, {reserve} are asked for")
    rows = [("primary", r.candidate_id, r.rank) for r in sorted(primary, key=lambda r: r.rank)] + [("reserve", r.candidate_id, r.rank) for r in spare]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], "review_order long, priority string, candidate_id string, rank long")
