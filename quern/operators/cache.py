"""What a runtime's caches would do with a trace of block accesses.

Each session's accesses are replayed in order by one task for a session; a replay's state is
bounded by the budgets, and traces stream through in batches.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.schema import HOT, MIB, NORMAL, STREAMING
from quern.session import ensure_workers_import


@dataclass(frozen=True)
class Budget:
    """Bytes for cached and for prefetched blocks; how many blocks wait for their second access; how many
    segments stay open."""

    block_bytes: int = 64 * MIB
    prefetch_bytes: int = 16 * MIB
    probation: int = 1024
    open_segments: int = 16

    @staticmethod
    def constrained() -> "Budget":
        return Budget(8 * MIB, 2 * MIB, 128, 4)

    @staticmethod
    def disabled() -> "Budget":
        return Budget(0, 0, 0, 1)


class OpenSegments:
    """Segments that are open, the least recently used going first."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.held: OrderedDict = OrderedDict()

    def use(self, segment) -> bool:
        """Whether the segment was open; it is now, as the last used."""
        if segment in self.held:
            self.held.move_to_end(segment)
            return True
        if self.most > 0:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[segment] = True
        return False


class ClockCache:
    """A cache of a byte budget that gives each entry a second chance before it goes."""

    def __init__(self, budget: int) -> None:
        self.budget = budget
        self.trim()

    def trim(self) -> None:
        self.used, self.hand = 0, 0
        self.slots: list[list | None] = []
        self.where: dict = {}

    def get(self, key) -> bool:
        slot = self.where.get(key)
        if slot is None:
            return False
        self.slots[slot][2] = True
        return True

    def insert(self, key, size: int) -> None:
        if not 0 <= size <= self.budget or self.budget == 0 or key in self.where:
            return
        slot = None
        while self.used + size > self.budget:
            slot = self._evict()
            if slot is None:
                return
        if slot is None:
            slot = next((i for i, x in enumerate(self.slots) if x is None), len(self.slots)) if len(self.where) < len(self.slots) else len(self.slots)
        if slot == len(self.slots):
            self.slots.append(None)
        self.slots[slot] = [key, size, True]
        self.where[key] = slot
        self.used += size

    def _evict(self) -> int | None:
        for _ in range(2 * len(self.slots)):
            at = self.hand % len(self.slots)
            self.hand = (at + 1) % len(self.slots)
            entry = self.slots[at]
            if entry is None:
                continue
            if entry[2]:
                entry[2] = False
                continue
            self.slots[at] = None
            self.used -= entry[1]
            del self.where[entry[0]]
            return at
        return None


class Replay:
    """One runtime: hot blocks are kept at once, normal ones from their second access, others
    never; a streaming session has its last two blocks at hand."""

    def __init__(self, budget: Budget) -> None:
        self.budget = budget
        self.blocks, self.ahead = ClockCache(budget.block_bytes), ClockCache(budget.prefetch_bytes)
        self.probation: deque = deque()
        self.recent: deque = deque(maxlen=2)

    def read(self, key, size: int, access: str) -> str:
        """Where the block comes from: "window", "cache", "prefetch" or "backend"."""
        if access == STREAMING:
            if key in self.recent:
                if self.recent[-1] != key:
                    self.recent.reverse()
                return "window"
            self.recent.append(key)
        if self.blocks.get(key):
            return "cache"
        if self.ahead.get(key):
            return "prefetch"
        if access == HOT or access == NORMAL and self._second(key):
            self.blocks.insert(key, size)
        return "backend"

    def prefetch(self, key, size: int) -> bool:
        """Whether the block was read ahead; not if it is larger than the budget, or kept already."""
        if not 0 < size <= self.budget.prefetch_bytes or self.blocks.get(key) or self.ahead.get(key):
            return False
        self.ahead.insert(key, size)
        return True

    def prefetch_all(self, blocks) -> int:
        """Reads the blocks (key, size) of a byte range ahead; returns how many were."""
        return sum(self.prefetch(key, size) for key, size in blocks)

    def _second(self, key) -> bool:
        if self.budget.probation == 0:
            return False
        if key in self.probation:
            self.probation.remove(key)
            return True
        while len(self.probation) >= self.budget.probation:
            self.probation.popleft()
        self.probation.append(key)
        return False


def replay(trace: DataFrame, budget: Budget) -> DataFrame:
    """trace (session, seq, block, size, access[, prefetch]) with from, where each read came from."""
    ensure_workers_import(trace.sparkSession)
    cols = ["session", "seq", "block", "size", "access"]
    source = trace.select(*cols, (F.col("prefetch") if "prefetch" in trace.columns else F.lit(False)).alias("prefetch"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = object(), Replay(budget)
        for pdf in batches:
            out = []
            for s, block, size, access, ahead in zip(pdf["session"], pdf["block"], pdf["size"].tolist(), pdf["access"], pdf["prefetch"]):
                if s != session:
                    session, state = s, Replay(budget)
                out.append(("ahead" if state.prefetch(block, size) else "skipped") if ahead else state.read(block, size, access))
            yield pdf[cols].assign(source=out)

    ordered = source.repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in cols), "source string"]))


def segment_opens(trace: DataFrame, budget: Budget) -> DataFrame:
    """trace (session, seq, segment_id) with opened: whether the access had to open the segment."""
    ensure_workers_import(trace.sparkSession)
    source = trace.select("session", "seq", "segment_id")
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = object(), OpenSegments(budget.open_segments)
        for pdf in batches:
            out = []
            for s, segment in zip(pdf["session"], pdf["segment_id"]):
                if s != session:
                    session, state = s, OpenSegments(budget.open_segments)
                out.append(not state.use(segment))
            yield pdf.assign(opened=out)

    ordered = source.repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in ("session", "seq", "segment_id")), "opened boolean"]))


def admission(access):
    """Whether a block of the class is kept at its first access, at its second, or never."""
    return F.when(access == HOT, F.lit("always")).when(access == NORMAL, F.lit("second")).otherwise(F.lit("never"))
