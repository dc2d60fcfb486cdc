"""Longest-processing-time sharding of groups that must stay together.

Groups go, largest first and equal sizes by key, to the shard with the least load, the lowest
of equals. Groups of one size form a run: what the heap does with a run depends on its size and
length alone, so one task folds the runs (one row for each distinct size) into phases, in each of
which the shards take turns. A group's shard follows from its rank in its run, by arithmetic; ranks
come from a range-partitioned order, so that no size, however frequent, is one task's. The result
equals the plain heap's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fits, free_name, prepare, quoted, text_of, written
from quern.operators.ordering import with_index

SHARDS = 64


def lpt(sizes: list[int], n_shards: int) -> list[int]:
    """The plain heap: shard of each of the sizes, given in descending order."""
    heap = [(0, j) for j in range(n_shards)]
    out = []
    for size in sizes:
        load, j = heapq.heappop(heap)
        out.append(j)
        heapq.heappush(heap, (load + size, j))
    return out


Phase = tuple[int, list[int]]


def phases(loads: np.ndarray, size: int, count: int) -> tuple[list[Phase], np.ndarray]:
    """How the heap deals `count` groups of one size to shards of the given loads: phases (rank at
    which it begins, shards in the order of their turns), and the loads after the run.

    Between two of the loads, only the shards below take groups, and they do so in turns, in the
    order of the load that each has when the phase begins.
    """
    before = loads = loads.astype(np.int64)
    loads = loads.copy()
    if size <= 0:
        return [(0, [int(loads.argmin())])], loads
    out: list[Phase] = []
    at, levels = 0, np.unique(loads)
    for k, low in enumerate(levels.tolist()):
        active = np.flatnonzero(before <= low)
        start = loads[active] + -(-(low - loads[active]) // size) * size
        order = np.lexsort((active, start))
        active, start = active[order], start[order]
        room = count - at
        if k + 1 < len(levels):
            each = np.maximum(0, -(-(int(levels[k + 1]) - start) // size))
            room = min(room, int(each.sum()))
        if room > 0:
            out.append((at, active.tolist()))
            turns = room // len(active) + (np.arange(len(active)) < room % len(active))
            loads[active] = np.where(turns > 0, start + turns * size, loads[active])
            at += room
        if at == count:
            break
    return out, loads


def place_run(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of `count` groups of one size the heap gives each shard, whose loads are given."""
    taken = np.zeros(len(loads), dtype=np.int64)
    dealt, _ = phases(loads, size, count)
    for (at, order), end in zip(dealt, [*(p[0] for p in dealt[1:]), count]):
        taken[order] += (end - at) // len(order) + (np.arange(len(order)) < (end - at) % len(order))
    return taken


def _fold(n_shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap, base = [(0, j) for j in range(n_shards)], 0
        for pdf in batches:
            rows = []
            for size, count in zip(pdf["size"].tolist(), pdf["n"].tolist()):
                if count <= n_shards:
                    turns = []
                    for _ in range(count):
                        load, j = heap[0]
                        heapq.heapreplace(heap, (load + size, j))
                        turns.append(j)
                    dealt = [(0, turns)]
                else:
                    loads = np.zeros(n_shards, dtype=np.int64)
                    for load, j in heap:
                        loads[j] = load
                    dealt, loads = phases(loads, size, count)
                    heap = [(int(load), j) for j, load in enumerate(loads)]
                    heapq.heapify(heap)
                rows.append((size, base, [{"start": at, "turns": order} for at, order in dealt]))
                base += count
            yield pd.DataFrame(rows, columns=["size", "base", "phases"])

    return run


#: Runs, and groups with their shards, are joined by shuffle if there are more of them than this.
BROADCAST_RUNS = 100_000
BROADCAST_GROUPS = 500_000


def assign_groups(groups: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Rows (key, shard) for rows (key, size), keys being distinct and not null, sizes whole and not negative."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    prepare(groups.sparkSession)
    placed = with_index(groups.select("key", "size"), [F.desc("size"), F.asc("key")], "place")
    counted = groups.groupBy("size").agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(F.desc("size"))
    runs = written(counted.mapInPandas(_fold(n_shards), "size bigint, base bigint, phases array<struct<start: bigint, turns: array<int>>>"))
    runs = F.broadcast(runs) if fits(runs, BROADCAST_RUNS) else runs
    rank = F.col("place") - F.col("base")
    joined = placed.join(runs, "size").select("key", rank.alias("rank"), "phases")
    phase = F.element_at(F.filter("phases", lambda p: p["start"] <= F.col("rank")), -1)
    turn = (F.col("rank") - F.col("phase.start")) % F.size("phase.turns")
    return joined.select("key", "rank", phase.alias("phase")).select("key", F.element_at("phase.turns", (turn + 1).cast("int")).alias("shard"))


def shard_documents(
    docs: DataFrame,
    n_shards: int = SHARDS,
    *,
    group: Column | None = None,
    size: Column | None = None,
    text_col: str = "text",
    shard_col: str = "shard",
) -> DataFrame:
    """docs with the number of the shard of each row's group.

    group: what must stay together; by default the text, so that no text is in two shards. size:
    a row's size, by default the characters of its text. A null group or text counts as an empty
    one, a null or negative size as 0. All columns stay; shard_col gets underscores if docs has
    such a column. Repeated rows count each; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    key_name, size_name = free_name(docs.columns, "__key"), free_name(docs.columns, "__size")
    shard = free_name(docs.columns, shard_col)
    key = F.md5(text_of(text_col)) if group is None else F.coalesce(group.cast("string"), F.lit(""))
    amount = F.length(text_of(text_col)) if size is None else size
    keyed = docs.withColumn(key_name, key)
    sized = docs.select(key.alias("key"), F.greatest(F.coalesce(amount.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    groups = sized.groupBy("key").agg(F.sum("size").alias("size"))
    assigned = written(assign_groups(written(groups), n_shards)).select(F.col("key").alias(key_name), F.col("shard").alias(shard))
    assigned = F.broadcast(assigned) if fits(assigned, BROADCAST_GROUPS) else assigned
    return keyed.join(assigned, key_name).select(*map(quoted, docs.columns), quoted(shard))
