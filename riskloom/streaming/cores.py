"""Core numbers maintained edge by edge, in memory and as the state of a stream."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.graph import peel


class Cores:
    """An undirected graph whose core numbers follow every inserted edge.

    An edge raises core numbers by one at most, and only of nodes whose number is the
    lesser one of its ends and that are joined to that end by such nodes. Of those, the
    ones stay behind that have too few neighbours at or above the next number.
    """

    def __init__(self):
        self.near: dict[str, set[str]] = {}
        self.core: dict[str, int] = {}

    @classmethod
    def of(cls, edges: Iterable[tuple[str, str]], nodes: Iterable[str] = ()) -> Cores:
        """A graph from all its edges at once, with isolated nodes."""
        out = cls()
        for n in nodes:
            out.add(n)
        for a, b in edges:
            if a != b:
                out.add(a)
                out.add(b)
                out.near[a].add(b)
                out.near[b].add(a)
        out.core |= out.recomputed()
        return out

    def add(self, node: str) -> None:
        if node not in self.near:
            self.near[node], self.core[node] = set(), 0

    def insert(self, a: str, b: str) -> set[str]:
        """Takes an edge; returns the nodes whose core number rose. Loops and repeated edges change nothing."""
        if a == b or b in self.near.get(a, ()):
            return set()
        self.add(a)
        self.add(b)
        self.near[a].add(b)
        self.near[b].add(a)
        level = min(self.core[a], self.core[b])
        rising = self.plateau(a if self.core[a] == level else b, level)
        fits = lambda n: sum(self.core[x] > level or x in rising for x in self.near[n]) > level
        doubtful = set(rising)
        while doubtful:
            gone = {n for n in doubtful if not fits(n)}
            rising -= gone
            doubtful = {x for n in gone for x in self.near[n]} & rising
        for n in rising:
            self.core[n] = level + 1
        return rising

    def plateau(self, start: str, level: int) -> set[str]:
        """Nodes of that core number which such nodes alone join to the start."""
        found, wave = {start}, {start}
        while wave:
            wave = {x for n in wave for x in self.near[n] if self.core[x] == level} - found
            found |= wave
        return found

    def recomputed(self) -> dict[str, int]:
        """Core numbers from the edges alone."""
        names = list(self.near)
        at = {n: i for i, n in enumerate(names)}
        ends = np.array([(at[n], at[x]) for n in names for x in self.near[n]], np.int64).reshape(-1, 2)
        return dict(zip(names, peel(len(names), ends[:, 0], ends[:, 1]).tolist()))

    def matches_batch(self) -> bool:
        return self.core == self.recomputed()


def maintained(edges: DataFrame, key: str = "graph") -> DataFrame:
    """(key, node, core) of every node whose core number is new or changed, of a stream of edges (key, src, dst).

    Each graph is one key and its state one task's; a graph for a whole corpus is the work
    of ``ingest.IncrementalCore``. Edges are only ever inserted.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        graph: Cores = pickle.loads(state.get[0]) if state.exists else Cores()
        before = dict(graph.core)
        touched: dict[str, int] = defaultdict(int)
        for pdf in batches:
            for a, b in zip(pdf["src"], pdf["dst"]):
                if a is not None and b is not None:
                    graph.insert(a, b)
        for n, c in graph.core.items():
            if before.get(n) != c:
                touched[n] = c
        state.update((pickle.dumps(graph),))
        if touched:
            yield pd.DataFrame({key: name[0], "node": list(touched), "core": list(touched.values())})

    kind = edges.schema[key].dataType.simpleString()
    return edges.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, node string, core long", "graph binary", "append", GroupStateTimeout.NoTimeout)
