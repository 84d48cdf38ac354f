"""Selection by several branches: seed pairs, a greedy choice among a pool of candidates, and swaps of single rows.

Each choice depends on all before it, so a branch runs in one task over the
graph's reduced arrays, which the driver and every branch's task hold whole;
branches run beside each other. More than ``most_rows`` rows are an error, none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from .graph import OBJECTIVE
from .normalize import EPS


@dataclass
class Graph:
    """What an objective is made of; rows are numbered in the order of their ids.

    ``mass[i, p]``: reliability times assignment weight; ``edges``: sequence
    (source, target); ``alike``: (a, b, penalty); ``matrices``: transition and
    co-occurrence over prototypes.
    """

    mass: np.ndarray
    reliability: np.ndarray
    rarity: np.ndarray
    transition: np.ndarray
    together: np.ndarray
    edges: np.ndarray
    alike: np.ndarray
    vectors: np.ndarray
    episodes: Sequence
    tasks: Sequence | None = None
    quotas: dict | None = None
    weights: Sequence[float] = OBJECTIVE
    steps: list = field(init=False)
    near: list = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.mass)
        self.steps, self.near = [[] for _ in range(n)], [[] for _ in range(n)]
        m = self.mass.shape[1]
        self.walks = np.zeros((m, m))
        for a, b in np.asarray(self.edges, int).reshape(-1, 2).tolist():
            self.walks += np.outer(self.mass[a], self.mass[b])
            self.steps[a].append((a, b))
            self.steps[b].append((a, b))
        for a, b, p in self.alike:
            self.near[int(a)].append((int(b), float(p)))
            self.near[int(b)].append((int(a), float(p)))
        self.scale = max(sum(float(p) for _, _, p in self.alike), EPS)
        self.bound = np.log1p(self.walks) + EPS
        self.pair = self.weights[1] * self.transition + self.weights[2] * self.together


class Chosen:
    """A set of rows and what the objective has to know of it."""

    def __init__(self, graph: Graph, rows: Sequence[int] = ()):
        self.graph, self.rows = graph, []
        self.taken: set[int] = set()
        self.cover, self.walked, self.redundancy, self.value = np.zeros(len(graph.rarity)), np.zeros_like(graph.walks), 0.0, 0.0
        self.used: dict = {}
        for k in rows:
            self.add(k)

    def _with(self, k: int) -> tuple[float, np.ndarray, np.ndarray, float]:
        g = self.graph
        cover = np.maximum(self.cover, g.mass[k])
        walked = self.walked
        for a, b in g.steps[k]:
            if (b if a == k else a) in self.taken:
                walked = walked + np.outer(g.mass[a], g.mass[b])
        redundancy = self.redundancy + sum(p for other, p in g.near[k] if other in self.taken)
        root = np.sqrt(cover)
        value = g.weights[0] * g.rarity @ cover + root @ g.pair @ root + g.weights[3] * (g.transition * np.log1p(walked) / g.bound).sum() - g.weights[4] * redundancy / g.scale
        return float(value), cover, walked, redundancy

    def gain(self, k: int) -> float:
        return self._with(k)[0] - self.value

    def add(self, k: int) -> float:
        before = self.value
        self.value, self.cover, self.walked, self.redundancy = self._with(k)
        self.taken.add(k)
        self.rows.append(k)
        if self.graph.tasks is not None:
            self.used[self.graph.tasks[k]] = self.used.get(self.graph.tasks[k], 0) + 1
        return self.value - before

    def open(self, task: object) -> bool:
        return self.graph.quotas is None or self.used.get(task, 0) < self.graph.quotas.get(task, 0)

    def may(self, k: int) -> bool:
        return k not in self.taken and (self.graph.quotas is None or self.open(self.graph.tasks[k]))


def pooled_greedy(graph: Graph, budget: int, start: Sequence[int] = (), seed: int = 42, best: int = 256, residual: int = 128, drawn: int = 128) -> Chosen:
    """``budget`` rows, each the best (ties to the first) of a pool whose gains are computed anew.

    The pool: the ``best`` rows by the gain last computed for them, the last
    choice's neighbours, the most reliable row of each of the ``residual`` least
    covered prototypes, ``drawn`` rows at random by reliability, and the most reliable row of every open task.
    """
    n = len(graph.mass)
    if not 0 < budget <= n or (graph.quotas is not None and sum(graph.quotas.values()) != budget):
        raise ValueError("the budget must lie within the rows and equal the quotas' sum")
    state = Chosen(graph)
    known = np.array([state.gain(k) for k in range(n)])
    for k in start:
        if not state.may(k):
            raise ValueError("the start breaks the quotas")
        state.add(k)
    rng, trust = np.random.default_rng(seed), np.lexsort((np.arange(n), -graph.reliability))
    while len(state.rows) < budget:
        free = np.array([k for k in range(n) if state.may(k)], int)
        if not len(free):
            raise ValueError("no row is left within the quotas")
        pool = set(free[np.lexsort((free, -known[free]))[:best]].tolist())
        if state.rows:
            last = state.rows[-1]
            pool |= {b if a == last else a for a, b in graph.steps[last]} | {other for other, _ in graph.near[last]}
        ordered = trust[np.isin(trust, free)]
        holds = graph.mass[ordered] > 0
        poor = [p for p in np.argsort(state.cover, kind="stable").tolist() if holds[:, p].any()][:residual]
        pool |= {int(ordered[int(holds[:, p].argmax())]) for p in poor}
        odds = graph.reliability[free].astype(float)
        pool |= set(rng.choice(free, size=min(drawn, len(free)), replace=False, p=odds / odds.sum()).tolist())
        if graph.quotas is not None:
            first: dict = {}
            for k in ordered.tolist():
                first.setdefault(graph.tasks[k], k)
            pool |= set(first.values())
        some = np.array(sorted(k for k in pool if state.may(k)))
        known[some] = [state.gain(k) for k in some.tolist()]
        state.add(int(some[int(known[some].argmax())]))
    return state


def seed_pairs(graph: Graph, branches: int = 8, kept: int = 128, most_alike: float = 0.9, least: float = 0.0, each: int = 4) -> list[tuple[int, int]]:
    """Pairs to start branches from, the best first and no two alike.

    Pairs are the sequence edges, and for each transition beyond ``least`` the
    first ``each`` pairs of unlike episodes, by reliability, whose rows have its two
    prototypes as their main ones. The ``kept`` best by objective compete; the pair
    of the rarest transition takes the last of the branches' places if it is not among them.
    """
    def fits(pair: tuple[int, int]) -> bool:
        if graph.quotas is None:
            return True
        own = [graph.tasks[k] for k in pair]
        return all(own.count(t) <= graph.quotas.get(t, 0) for t in own)

    pairs = {p for p in map(tuple, np.asarray(graph.edges, int).reshape(-1, 2).tolist()) if fits(p)}
    main = graph.mass.argmax(1)
    holders = [sorted(np.flatnonzero(main == p).tolist(), key=lambda k: (-graph.reliability[k], k)) for p in range(graph.mass.shape[1])]
    more, rare = transition_pairs(graph, holders, least, each, fits)
    return unlike_pairs(graph, ranked_pairs(graph, pairs | more, rare, branches, kept), branches, most_alike)


def transition_pairs(graph: Graph, holders: list[list[int]], least: float, each: int, fits: Callable[[tuple[int, int]], bool]) -> tuple[set[tuple[int, int]], tuple | None]:
    """The first pairs of each transition beyond ``least``, and the rarest one's first with its rank; ``holders``: each prototype's rows in order."""
    pairs, rare = set(), None
    for p, q in sorted(zip(*np.nonzero(graph.transition > least), strict=True), key=lambda x: (-graph.transition[x], x)):
        # a source's pairs are searched lazily, so a large prototype costs no more than it gives
        found = ((a, b) for a in holders[p] for b in holders[q] if a != b and graph.episodes[a] != graph.episodes[b] and fits((a, b)))
        some = [pair for pair, _ in zip(found, range(each), strict=False)] if each else []
        new, rank = some[:1], None
        if new:
            a, b = new[0]
            rank = (graph.transition[p, q], -graph.reliability[a] * graph.reliability[b], a, b)
            rare = min(rare, (rank, new[0])) if rare else (rank, new[0])
        pairs |= set(some)
    return pairs, rare


def ranked_pairs(graph: Graph, pairs: set[tuple[int, int]], rare: tuple | None, branches: int, kept: int) -> list[tuple[int, int]]:
    ranked = sorted(pairs, key=lambda pair: (-Chosen(graph, pair).value, pair))[:kept]
    if rare and rare[1] not in ranked:
        place = max(0, min(len(ranked), branches) - 1)
        ranked[place : place + (len(ranked) >= kept)] = [rare[1]]
    return ranked


def unlike_pairs(graph: Graph, ranked: list[tuple[int, int]], branches: int, most_alike: float) -> list[tuple[int, int]]:
    """The first pairs, without those whose vectors are like an earlier one's."""
    out: list[tuple[int, int]] = []
    units: list[np.ndarray] = []
    for pair in ranked:
        both = np.concatenate([graph.vectors[pair[0]], graph.vectors[pair[1]]]).astype(float)
        both /= max(float(np.linalg.norm(both)), EPS)
        if len(out) < branches and not any(set(pair) == set(old) or both @ unit >= most_alike for old, unit in zip(out, units, strict=True)):
            out.append(pair)
            units.append(both)
    return out


def swapped(state: Chosen, rounds: int = 2, chosen: int = 128, others: int = 256) -> tuple[Chosen, list[tuple[int, int]]]:
    """The set after up to ``rounds`` exchanges of one row, each the best there is, and the exchanges (removed, added).

    The ``chosen`` rows that brought least when they were added meet the ``others`` that would bring most, of the same task if there are quotas.
    """
    graph, swaps = state.graph, []
    for _ in range(rounds):
        again = Chosen(graph)
        brought = [again.add(k) for k in state.rows]
        outside = np.array([k for k in range(len(graph.mass)) if k not in again.taken], int)
        promise = np.array([again.gain(k) for k in outside.tolist()])
        found = exchange(again, brought, outside[np.lexsort((outside, -promise))[:others]].tolist(), chosen)
        if found is None:
            break
        state = Chosen(graph, found[0])
        swaps.append(found[1])
    return state, swaps


def exchange(state: Chosen, brought: list[float], strong: list[int], chosen: int) -> tuple[list[int], tuple[int, int]] | None:
    """The rows after the best exchange with one of ``strong``, and the exchange, if any gives more; ``brought``: what each row of the set brought."""
    graph = state.graph
    weak = sorted(range(len(brought)), key=lambda i: (brought[i], state.rows[i]))[:chosen]
    best, found = state.value + 1e-12, None
    for i in weak:
        rest = Chosen(graph, state.rows[:i] + state.rows[i + 1 :])
        for k in strong:
            if graph.quotas is not None and graph.tasks[k] != graph.tasks[state.rows[i]]:
                continue
            value = rest.value + rest.gain(k)
            if value > best:
                best, found = value, ([*state.rows[:i], k, *state.rows[i + 1 :]], (state.rows[i], k))
    return found


def best_branch(spark: SparkSession, graph: Graph, budget: int, branches: int = 8, seed: int = 42, rounds: int = 2, most_rows: int = 2_000_000) -> pd.DataFrame:
    """``branch, objective, chosen``, the best branch first: one without a start and one from each seed pair, each greedy and then refined by swaps.

    Branches are tasks of one job (a row each goes out and comes back). Equal objectives go by the smaller rows.
    """
    if len(graph.mass) > most_rows:
        raise ValueError(f"{len(graph.mass)} rows are more than {most_rows}")
    starts = [(), *(seed_pairs(graph, branches - 1) if budget > 1 and branches > 1 else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for branch in part["id"].tolist():
                found, _ = swapped(pooled_greedy(graph, budget, starts[branch], seed + branch), rounds)
                yield pd.DataFrame({"branch": [branch], "objective": [found.value], "chosen": [found.rows]})

    rows = spark.range(len(starts), numPartitions=len(starts)).mapInPandas(run, "branch long, objective double, chosen array<long>").toPandas()
    rows["chosen"] = rows["chosen"].map(lambda x: [int(k) for k in x])
    order = sorted(range(len(rows)), key=lambda i: (-rows["objective"][i], sorted(rows["chosen"][i])))
    return rows.iloc[order].reset_index(drop=True)
