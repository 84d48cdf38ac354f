"""``branches.best_branch`` over tables of any number of rows.

All branches go on step by step beside each other. The driver holds the rows
that a pool has had so far (some hundreds a branch and choice), the first rows
of every task by the orders that pools are filled from, and sums over
``BLOCKS`` blocks of rows; whatever else a step asks for comes from a pass over
the stored table. The choices are those of ``branches`` on the whole graph:
same pools, same random numbers, same order of ties.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import branches as b
from .graph import OBJECTIVE
from .normalize import EPS
from .ordering import numbered
from .stored import stored

#: Blocks at most, rows of a block at least, rows of a stored part at most, and numbers of the matrices made at once.
BLOCKS, BLOCK, PART, AT_ONCE = 4096, 256, 50_000, 1 << 18


@dataclass
class Objective:
    """The whole table's numbers that gains are computed with (see ``branches.Graph``)."""

    rarity: np.ndarray
    transition: np.ndarray
    together: np.ndarray
    weights: Sequence[float] = OBJECTIVE
    walks: np.ndarray | None = None
    penalty: float = 0.0

    def complete(self) -> None:
        self.pair = self.weights[1] * self.transition + self.weights[2] * self.together
        self.scale = max(self.penalty, EPS)
        self.bound = np.log1p(np.zeros_like(self.transition) if self.walks is None else self.walks) + EPS

    def covered(self, cover: np.ndarray) -> np.ndarray:
        """Node, transition and co-occurrence value of each row of coverages; equal rows give equal values, wherever they stand."""
        root = np.sqrt(cover)
        out = self.weights[0] * (cover * self.rarity).sum(1)
        for p in range(cover.shape[1]):
            out = out + root[:, p] * (root * self.pair[p]).sum(1)
        return out


@dataclass
class Seen(Objective):
    """The part of the graph that the driver has met, by row number; ``branches.Chosen`` works on it as on a whole ``Graph``."""

    quotas: dict | None = None
    mass: dict = field(default_factory=dict)
    reliability: dict = field(default_factory=dict)
    tasks: dict = field(default_factory=dict)
    episodes: dict = field(default_factory=dict)
    vectors: dict = field(default_factory=dict)
    steps: dict = field(default_factory=lambda: defaultdict(list))
    near: dict = field(default_factory=lambda: defaultdict(list))
    linked: set = field(default_factory=set)
    met: set = field(default_factory=set)

    def see(self, rows: pd.DataFrame) -> list[int]:
        """Adds rows of ``row, task, reliability, mass``."""
        for k, task, trust, mass in zip(rows["row"].tolist(), rows["task"].tolist(), rows["reliability"].tolist(), rows["mass"], strict=True):
            self.mass[k], self.reliability[k], self.tasks[k] = np.asarray(mass, float), trust, task
        return rows["row"].tolist()

    def around(self, k: int) -> set[int]:
        return {y if x == k else x for x, y in self.steps[k]} | {o for o, _ in self.near[k]}


def _numpy(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def _matrices(a: pd.Series, z: pd.Series, forward: np.ndarray, backward: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows, both ends' masses, and their sequence counts by prototype pair."""
    a, z = _numpy(a), _numpy(z)
    size = max(1, AT_ONCE // a.shape[1] ** 2)
    for lo in range(0, len(a), size):
        at = slice(lo, lo + size)
        yield at, a[at], z[at], forward[at, None, None] * a[at, :, None] * z[at, None, :] + backward[at, None, None] * z[at, :, None] * a[at, None, :]


class _First:
    """The rows of a task in one order, as many as were asked for so far; the next ones come from a pass."""

    def __init__(self, rows: DataFrame, size: int, seen: Seen):
        self.rows, self.size, self.seen, self.found, self.whole = rows, size, seen, [], False

    def add(self, part: pd.DataFrame) -> None:
        self.seen.see(part)
        self.found += list(zip(part["key"].tolist(), part["row"].tolist(), strict=True))
        self.whole = len(part) < self.size

    def __iter__(self) -> Iterator[tuple[float, int]]:
        at = 0
        while True:
            while at < len(self.found):
                yield self.found[at]
                at += 1
            if self.whole:
                return
            rest = self.rows
            if self.found:
                key, row = self.found[-1]
                rest = rest.filter((F.col("key") < key) | ((F.col("key") == key) & (F.col("row") > row)))
            self.add(rest.orderBy(F.desc("key"), "row").limit(self.size).toPandas())


class Tables:
    """The stored rows and links of a graph, and the passes over them."""

    def __init__(self, rows: DataFrame, edges: DataFrame, alike: DataFrame, seen: Seen, width: int):
        self.seen, self.width, self.spark = seen, width, rows.sparkSession
        task = F.col("task") if seen.quotas is not None else F.lit(0)
        rows = stored(numbered(rows.withColumn("task", task), F.col("node"), name="row").withColumn("row", F.col("row") - 1))
        self.n = rows.count()
        self.tasks = [r[0] for r in rows.select("task").distinct().orderBy("task").collect()]
        self.code, self.whole = {t: c for c, t in enumerate(self.tasks)}, {}
        self._rows(rows)
        self._links(edges, alike)

    def _rows(self, rows: DataFrame) -> None:
        """The table with every row's value alone and main prototype, and the same as blocks in order."""
        seen = self.seen
        seen.complete()

        def alone(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    mass = _numpy(part["mass"])
                    yield part.assign(alone=seen.covered(mass), main=mass.argmax(1))

        kept = ("row", "node", "episode_id", "task", "reliability", "mass", "vec")
        schema = rows.select(*kept).withColumns({"alone": F.lit(0.0), "main": F.lit(0).cast("long")}).schema
        self.rows = stored(rows.select(*kept).mapInPandas(alone, schema))
        self.size = max(BLOCK, math.ceil(self.n / BLOCKS))
        count = self.n // self.size + 1
        parts = max(min(2 * self.spark.sparkContext.defaultParallelism, count // 4), math.ceil(self.n / PART), 1)
        in_block = self.rows.select(F.floor(F.col("row") / self.size).cast("long").alias("block"), F.struct("row", "task", "reliability", "mass").alias("r")).repartition(parts, "block")
        listed = in_block.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))
        one = lambda name: F.transform("r", lambda x: x[name]).alias(name)
        self.blocks = stored(listed.select("block", one("row"), one("task"), one("reliability"), F.flatten(F.transform("r", lambda x: x["mass"])).alias("mass")))
        # how many rows of a block and task a draw can take, and their reliabilities' sum
        self.odds, self.held, self.many = np.zeros((count, len(self.tasks))), np.zeros((count, len(self.tasks)), int), np.zeros(len(self.tasks), int)
        by_block = self.rows.groupBy(F.floor(F.col("row") / self.size).alias("block"), "task").agg(F.sum("reliability"), F.sum((F.col("reliability") > 0).cast("int")), F.count(F.lit(1)))
        for block, task, odds, held, many in by_block.collect():
            c = self.code[task]
            self.odds[block, c], self.held[block, c] = odds, held
            self.many[c] += many

    def _links(self, edges: DataFrame, alike: DataFrame) -> None:
        """``links``: each linked pair once with its edges either way, its penalty and both ends' masses; and the sums over all of them."""
        seen, zero = self.seen, F.lit(0).cast("long")
        low, high, turned = F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), F.col("source") > F.col("target")
        both = edges.select(low, high, (~turned).cast("long").alias("forward"), turned.cast("long").alias("backward"), F.lit(0.0).alias("penalty")).unionByName(
            alike.select(low, high, zero.alias("forward"), zero.alias("backward"), F.col("penalty").cast("double").alias("penalty")))
        pairs = both.groupBy("low", "high").agg(F.sum("forward").alias("forward"), F.sum("backward").alias("backward"), F.sum("penalty").alias("penalty"))
        end = lambda node, at: self.rows.select(F.col("node").alias(node), F.col("row").alias(at), F.col("task").alias(f"{at}_task"), F.col("mass").alias(f"{at}_mass"))
        self.links = stored(pairs.join(end("low", "a"), "low").join(end("high", "z"), "high").drop("low", "high"))

        def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(seen.transition.size + 1)
            for part in parts:
                if len(part):
                    sums[-1] += part["penalty"].sum()
                    for *_, counts in _matrices(part["a_mass"], part["z_mass"], part["forward"].to_numpy(float), part["backward"].to_numpy(float)):
                        sums[:-1] += counts.sum(0).ravel()
            yield pd.DataFrame({"at": np.arange(len(sums)), "value": sums})

        sums = np.zeros(self.width**2 + 1)
        for at, value in self.links.mapInPandas(summed, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
            sums[at] = value
        seen.walks, seen.penalty = sums[:-1].reshape(self.width, self.width), float(sums[-1])
        seen.complete()

    def first(self, order: str | int, task: object) -> DataFrame:
        """A task's rows as ``key, row, task, reliability, mass``: by value alone, by reliability, or (a number) those that hold a prototype, by reliability."""
        rows = self.rows.filter(F.col("task") == F.lit(task))
        if isinstance(order, int):
            rows = rows.filter(F.col("mass")[order] > 0)
        return rows.select(F.col("alone" if order == "alone" else "reliability").alias("key"), "row", "task", "reliability", "mass")

    def firsts(self, orders: Sequence, size: int) -> dict:
        """The beginnings of ``orders`` for all tasks, by order and task, in one pass."""
        if orders == ["alone"]:
            rows = self.rows.withColumns({"list": F.lit(0), "key": F.col("alone")})
        else:
            lists = [F.when(F.col("mass")[o] > 0, F.lit(k)) if isinstance(o, int) else F.lit(k) for k, o in enumerate(orders)]
            rows = self.rows.withColumns({"list": F.explode(F.array_compact(F.array(*lists))), "key": F.col("reliability")})
        rows = rows.select("list", "key", "row", "task", "reliability", "mass")
        place = F.row_number().over(W.partitionBy("list", "task").orderBy(F.desc("key"), "row"))
        table = rows.withColumn("place", place).filter(F.col("place") <= size).drop("place").toPandas().sort_values(["key", "row"], ascending=[False, True])
        out = {(o, t): _First(self.first(o, t), size, self.seen) for o in orders for t in self.tasks}
        for f in out.values():
            f.whole = True
        for (k, t), part in table.groupby(["list", "task"]):
            out[orders[k], t].add(part)
        return out

    def meet(self, rows: Iterable[int]) -> None:
        """The driver learns of all links of ``rows``."""
        seen, new = self.seen, sorted(set(rows) - self.seen.met)
        if not new:
            return
        found = self.links.filter((F.col("a").isin(new) | F.col("z").isin(new)) & (F.col("a") != F.col("z"))).select("a", "z", "forward", "backward", "penalty").collect()
        for a, z, forward, backward, penalty in sorted(found):
            if (a, z) in seen.linked:
                continue
            seen.linked.add((a, z))
            for k in (a, z):
                seen.steps[k] += [(a, z)] * forward + [(z, a)] * backward
            if penalty:
                seen.near[a].append((z, penalty))
                seen.near[z].append((a, penalty))
        seen.met.update(new)

    def fetch(self, rows: Iterable[int], hits: Sequence[tuple[int, int, float, int]] = (), gone: dict | None = None, open_: dict | None = None) -> dict:
        """The driver learns of ``rows``, and of those that the ``hits`` fall on, which are returned by their number.

        A hit is (block, branch, place, number): in the order of rows, the first one of
        the block at which the sum of reliabilities over the branch's open tasks without its ``gone`` rows exceeds the place.
        """
        wanted, falls, size = defaultdict(list), defaultdict(lambda: defaultdict(list)), self.size
        for k in set(rows) - self.seen.mass.keys():
            wanted[k // size].append(k)
        for block, branch, place, number in hits:
            falls[block][branch].append((place, number))
        wanted, falls = dict(wanted), {block: dict(x) for block, x in falls.items()}
        if not wanted and not falls:
            return {}
        gone = {x: np.array(sorted(k)) for x, k in (gone or {}).items()}
        names = {x: set(t) for x, t in (open_ or {}).items()}

        def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for block, row, task, trust, mass in part[["block", "row", "task", "reliability", "mass"]].itertuples(index=False, name=None):
                    row, task, trust = np.asarray(row), np.asarray(task), np.asarray(trust, float)
                    mass = np.asarray(mass, float).reshape(len(row), -1)
                    at, number = [int(np.searchsorted(row, k)) for k in wanted.get(block, ())], [-1] * len(wanted.get(block, ()))
                    for branch, places in falls.get(block, {}).items():
                        free = np.array([t in names[branch] for t in task.tolist()]) & ~np.isin(row, gone[branch])
                        sums, some = np.cumsum(np.where(free, trust, 0.0)), np.flatnonzero(free & (trust > 0))
                        for place, which in places:
                            at.append(min(int(np.searchsorted(sums, place, side="right")), int(some[-1])))
                            number.append(which)
                    if at:
                        yield pd.DataFrame({"number": number, "row": row[at], "task": task[at], "reliability": trust[at], "mass": mass[at].tolist()})

        schema = self.rows.select(F.lit(0).cast("long").alias("number"), "row", "task", "reliability", "mass").schema
        found = self.blocks.filter(F.col("block").isin(sorted(wanted.keys() | falls.keys()))).mapInPandas(look, schema).toPandas()
        return {n: k for n, k in zip(found["number"].tolist(), self.seen.see(found), strict=True) if n >= 0}

    def draw(self, states: dict, rngs: dict, size: int) -> dict[int, set[int]]:
        """Up to ``size`` rows for each branch, by reliability and without replacement: what ``Generator.choice`` draws from all free rows in order."""
        seen, found, weight, open_, spent = self.seen, {}, {}, {}, {}
        for x, s in states.items():
            open_[x] = [t for t in self.tasks if seen.quotas is None or s.used.get(t, 0) < seen.quotas.get(t, 0)]
            codes, found[x], spent[x] = [self.code[t] for t in open_[x]], [], [k for k in s.rows if seen.tasks[k] in set(open_[x])]
            odds, held = self.odds[:, codes].sum(1), self.held[:, codes].sum(1)
            weight[x] = (odds, held)
            for k in spent[x]:
                self._take(weight[x], k)
        out = {}
        for x in list(states):
            if weight[x][1].sum() <= size:  # every row that can be drawn is, now and later
                key = tuple(open_[x])
                if key not in self.whole:
                    rows = self.rows.filter(F.col("task").isin(open_[x]) & (F.col("reliability") > 0)).select("row", "task", "reliability", "mass")
                    self.whole[key] = set(seen.see(rows.toPandas()))
                out[x] = self.whole[key] - states[x].taken
        going = [x for x in states if x not in out]
        while going:
            hits, owner = [], []
            for x in going:
                sums = np.cumsum(np.where(weight[x][1] > 0, np.maximum(weight[x][0], 0.0), 0.0))
                places = rngs[x].random(size - len(found[x])) * sums[-1]
                blocks = np.minimum(np.searchsorted(sums, places, side="right"), np.flatnonzero(weight[x][1] > 0)[-1])
                for block, place in zip(blocks.tolist(), places.tolist(), strict=True):
                    hits.append((block, x, place - (sums[block - 1] if block else 0.0), len(owner)))
                    owner.append(x)
            gone = {x: [*states[x].rows, *found[x]] for x in going}
            fallen = self.fetch((), hits, gone, {x: open_[x] for x in going})
            for number, x in enumerate(owner):  # a row that is hit twice counts once
                if fallen[number] not in found[x]:
                    found[x].append(fallen[number])
                    self._take(weight[x], fallen[number])
            going = [x for x in going if len(found[x]) < size]
        return out | {x: set(k) for x, k in found.items() if x not in out}

    def _take(self, weight: tuple[np.ndarray, np.ndarray], k: int) -> None:
        if self.seen.reliability[k] > 0:
            weight[0][k // self.size] -= self.seen.reliability[k]
            weight[1][k // self.size] -= 1

    def promising(self, states: dict, most: int) -> dict[int, list[int]]:
        """For each branch the ``most`` rows outside it that would bring most now, ties to the first."""
        seen = self.seen
        plain = {x: (s.cover, s.value, s.value - float(seen.covered(s.cover[None])[0])) for x, s in states.items()}
        linked = {x: set().union(*(seen.around(k) for k in s.rows)) - set(s.rows) for x, s in states.items()}
        skip = {x: np.array(sorted(linked[x] | set(s.rows))) for x, s in states.items()}
        objective = Objective(seen.rarity, seen.transition, seen.together, seen.weights, seen.walks, seen.penalty)
        objective.complete()

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = {x: None for x in plain}
            for part in parts:
                if not len(part):
                    continue
                row, task, trust, mass = (np.concatenate(part[c].to_list()) for c in ("row", "task", "reliability", "mass"))
                mass = mass.reshape(len(row), -1)
                for x, (cover, value, rest) in plain.items():
                    gain = objective.covered(np.maximum(cover, mass)) + rest - value
                    free = np.flatnonzero(~np.isin(row, skip[x]))
                    free = free[np.lexsort((row[free], -gain[free]))[:most]]
                    new = pd.DataFrame({"branch": x, "gain": gain[free], "row": row[free], "task": task[free], "reliability": trust[free], "mass": mass[free].tolist()})
                    new = new if held[x] is None else pd.concat([held[x], new])
                    held[x] = new.sort_values(["gain", "row"], ascending=[False, True]).head(most)
            yield from (h for h in held.values() if h is not None and len(h))

        schema = self.rows.select(F.lit(0).cast("long").alias("branch"), F.lit(0.0).alias("gain"), "row", "task", "reliability", "mass").schema
        place = F.row_number().over(W.partitionBy("branch").orderBy(F.desc("gain"), "row"))
        found = self.blocks.mapInPandas(best, schema).withColumn("place", place).filter(F.col("place") <= most).toPandas()
        seen.see(found)
        out = {}
        for x, s in states.items():
            mine = found[found["branch"] == x]
            every = [*zip((-mine["gain"]).tolist(), mine["row"].tolist(), strict=True), *((-s.gain(k), k) for k in linked[x])]
            out[x] = [k for _, k in sorted(every)[:most]]
        return out

    def seed_pairs(self, count: int, kept: int = 128, most_alike: float = 0.9, least: float = 0.0, each: int = 4) -> list[tuple[int, int]]:
        """``branches.seed_pairs``: the best pairs of the sequence edges come from a pass, and the holders of a prototype are the first that its pairs can need."""
        seen, fits = self.seen, lambda a, z: seen.quotas is None or (a != z and min(seen.quotas.get(a, 0), seen.quotas.get(z, 0)) > 0) or (a == z and seen.quotas.get(a, 0) > 1)

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                part = part[(part["a"] != part["z"]) & (part["forward"] + part["backward"] > 0)]
                part = part[[fits(a, z) for a, z in zip(part["a_task"], part["z_task"], strict=True)]]
                if not len(part):
                    continue
                value = -seen.weights[4] * part["penalty"].to_numpy() / seen.scale
                for at, a, z, counts in _matrices(part["a_mass"], part["z_mass"], part["forward"].to_numpy(float), part["backward"].to_numpy(float)):
                    value[at] += seen.covered(np.maximum(a, z)) + seen.weights[3] * (seen.transition * np.log1p(counts) / seen.bound).sum((1, 2))
                part = part[["a", "z", "forward", "backward"]].assign(value=value)
                both = pd.concat([part[part["forward"] > 0], part[part["backward"] > 0].rename(columns={"a": "z", "z": "a"})])
                yield both[["a", "z", "value"]].sort_values(["value", "a", "z"], ascending=[False, True, True]).head(kept)

        pairs = {(r[0], r[1]) for r in self.links.mapInPandas(best, "a long, z long, value double").orderBy(F.desc("value"), "a", "z").limit(kept).collect()}
        order = (F.desc("reliability"), F.col("row"))
        held = self.rows.select("main", "task", "episode_id", "row", "reliability", "mass")
        # without any one episode, as many are left as a row's pairs can need
        for by, most in ((("main", "task", "episode_id"), each), (("main", "task"), 2 * each)):
            held = held.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most).drop("place")
        held = held.toPandas().sort_values(["reliability", "row"], ascending=[False, True])
        seen.see(held)
        seen.episodes.update(zip(held["row"].tolist(), held["episode_id"].tolist(), strict=True))
        holders = [held["row"][held["main"] == p].tolist() for p in range(self.width)]
        more, rare = b.transition_pairs(seen, holders, least, each, lambda pair: fits(*(seen.tasks[k] for k in pair)))
        pairs |= more
        ends = {k for pair in pairs for k in pair}
        self.fetch(ends)
        self.meet(ends)
        ranked = b.ranked_pairs(seen, pairs, rare, count, kept)
        some = sorted({k for pair in ranked for k in pair})
        seen.vectors.update((r[0], np.array(r[1], float)) for r in self.rows.filter(F.col("row").isin(some)).select("row", "vec").collect())
        return b.unlike_pairs(seen, ranked, count, most_alike)


def greedy(tables: Tables, budget: int, starts: Sequence[Sequence[int]], seed: int = 42, best: int = 256, residual: int = 128, drawn: int = 128) -> list[b.Chosen]:
    """``branches.pooled_greedy`` for every start, all a choice at a time."""
    seen = tables.seen
    if not 0 < budget <= tables.n or (seen.quotas is not None and sum(seen.quotas.values()) != budget):
        raise ValueError("the budget must lie within the rows and equal the quotas' sum")
    tables.fetch(k for start in starts for k in start)
    tables.meet(k for start in starts for k in start)
    states = {x: b.Chosen(seen) for x in range(len(starts))}
    for x, start in enumerate(starts):
        for k in start:
            if not states[x].may(k):
                raise ValueError("the start breaks the quotas")
            states[x].add(k)
    value = tables.firsts(["alone"], 8 * best)
    trust = tables.firsts(["reliability", *range(tables.width)], min(budget, 64) + 1)
    rngs, known = {x: np.random.default_rng(seed + x) for x in states}, {x: {} for x in states}
    while going := {x: s for x, s in states.items() if len(s.rows) < budget}:
        last = {s.rows[-1] for s in going.values() if s.rows}
        tables.meet(last)
        tables.fetch(o for k in last for o in seen.around(k))
        for s in going.values():
            if sum(int(tables.many[c]) for t, c in tables.code.items() if seen.quotas is None or s.used.get(t, 0) < seen.quotas.get(t, 0)) <= sum(s.open(seen.tasks[k]) for k in s.rows):
                raise ValueError("no row is left within the quotas")
        draws = tables.draw(going, rngs, drawn)
        for x, s in going.items():
            open_ = [t for t in tables.tasks if s.open(t)]
            rows = [(-v, k) for k, v in known[x].items() if s.may(k)]
            for t in open_:
                some = ((-v, k) for v, k in value["alone", t] if k not in known[x] and k not in s.taken)
                rows += [row for row, _ in zip(some, range(best), strict=False)]
            pool = {k for _, k in sorted(rows)[:best]}
            if s.rows:
                pool |= seen.around(s.rows[-1])

            def leader(order: object) -> int | None:
                found = [f for t in open_ if (f := _next(trust[order, t], s.taken))]  # noqa: B023
                return min(found)[1] if found else None

            poor = (leader(p) for p in np.argsort(s.cover, kind="stable").tolist())
            pool |= {k for k, _ in zip((k for k in poor if k is not None), range(residual), strict=False)}
            pool |= draws[x]
            if seen.quotas is not None:
                pool |= {f[1] for t in open_ if (f := _next(trust["reliability", t], s.taken))}
            some = sorted(k for k in pool if s.may(k))
            gains = [s.gain(k) for k in some]
            known[x].update(zip(some, gains, strict=True))
            s.add(some[int(np.argmax(gains))])
    return list(states.values())


def _next(first: _First, taken: set) -> tuple[float, int] | None:
    """The first row of an order that is not taken, as it sorts among those of other tasks."""
    return next(((-r, k) for r, k in first if k not in taken), None)


def refine(tables: Tables, states: list[b.Chosen], rounds: int = 2, chosen: int = 128, others: int = 256) -> list[b.Chosen]:
    """``branches.swapped`` for every set, a pass over the rows a round."""
    going, states = list(range(len(states))), list(states)
    for _ in range(rounds):
        tables.meet(k for x in going for k in states[x].rows)
        tables.fetch(o for x in going for k in states[x].rows for o in tables.seen.around(k))
        again = {x: b.Chosen(tables.seen) for x in going}
        brought = {x: [again[x].add(k) for k in states[x].rows] for x in going}
        strong = tables.promising(again, others) if going else {}
        found = {x: b.exchange(again[x], brought[x], strong[x], chosen) for x in going}
        going = [x for x in going if found[x] is not None]
        for x in going:
            states[x] = b.Chosen(tables.seen, found[x][0])
    return states


def best_branch(rows: DataFrame, edges: DataFrame, alike: DataFrame, rarity: np.ndarray, transition: np.ndarray, together: np.ndarray, budget: int, quotas: dict | None = None,
                branches: int = 8, seed: int = 42, rounds: int = 2, weights: Sequence[float] = OBJECTIVE) -> pd.DataFrame:
    """``branch, objective, chosen`` as ``branches.best_branch``, with nodes instead of row numbers.

    ``rows``: ``node`` (each once), ``episode_id, task, reliability, mass, vec``, the last two arrays
    of numbers, ``mass`` one a prototype; ``edges``: ``source, target``; ``alike``: ``source, target, penalty``. Matrices are over prototypes.
    """
    tables = Tables(rows, edges, alike, Seen(np.asarray(rarity, float), transition, together, weights, quotas=quotas), len(rarity))
    starts = [(), *(tables.seed_pairs(branches - 1) if budget > 1 and branches > 1 else [])]
    found = refine(tables, greedy(tables, budget, starts, seed), rounds)
    order = sorted(range(len(found)), key=lambda x: (-found[x].value, sorted(found[x].rows)))
    every = sorted({k for s in found for k in s.rows})
    node = dict(tables.rows.filter(F.col("row").isin(every)).select("row", "node").collect())
    return pd.DataFrame({"branch": order, "objective": [found[x].value for x in order], "chosen": [[node[k] for k in found[x].rows] for x in order]})
