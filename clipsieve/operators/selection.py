"""Choosing clips: top k, percentages, quotas, and sequential selection under a budget.

Sequential rules depend on what was chosen before. ``covering_selection`` and
``budget_selection`` pass over a table of any size; the others run in numpy on
the clips' reduced rows (id, scores, a short vector), which their callers bound.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_validation
from .ordering import numbered
from .stored import stored


def ranked(scores: DataFrame, score: str) -> DataFrame:
    """Adds ``place``: by score, shorter clips first among equals, then by id."""
    return numbered(scores, -F.col(score), F.col("length"), F.col("sample_id"))


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows; only the best k of each task are merged."""
    if k < 0:
        raise ValueError("k must not be negative")
    return scores.orderBy(F.desc(score), "length", "sample_id").limit(k)


def percent_budget(n: int, percent: str | float, decimal: bool = True) -> int:
    """ceil(n * percent / 100), in decimals (exact) or in floats."""
    if decimal:
        return int((Decimal(n) * Decimal(str(percent)) / 100).to_integral_value(ROUND_CEILING))
    return math.ceil(n * float(percent) / 100)


def ratio_budget(n: int, ratio: float) -> int:
    """n * ratio rounded half up; it must be between 1 and n."""
    k = math.floor(n * ratio + 0.5)
    if not 1 <= k <= n:
        raise ValueError(f"budget {k} is not between 1 and {n}")
    return k


def top_percent(scores: DataFrame, score: str, percent: str | float, decimal: bool = True) -> DataFrame:
    return top_k(scores, score, percent_budget(scores.count(), percent, decimal))


def per_group_percent(rows: DataFrame, group: str, percent: float, seed: int) -> DataFrame:
    """ceil(n * percent / 100) rows of each group, by a hash of seed and id (md5), without replacement."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id"))
    sized = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) * percent / 100).alias("quota"))
    placed = numbered(rows, key, F.col("sample_id"), by=[group], name="r_")
    return placed.join(sized, group).filter(F.col("r_") <= F.col("quota")).drop("r_", "quota")


def allocate_quotas(capacities: dict, budget: int, minimum: int) -> dict:
    """A budget dealt to tasks in proportion to their sizes: ``minimum`` first, the largest remainders last, ties to the smaller task.

    No task gets more than it has; what it can't take is dealt again among the others.
    """
    if budget > sum(capacities.values()):
        raise ValueError("the budget exceeds what there is")
    quotas = {t: min(minimum, c) for t, c in capacities.items()}
    if sum(quotas.values()) > budget:
        raise ValueError("the budget is below the tasks' minimum")
    while (rest := budget - sum(quotas.values())) > 0:
        open_ = {t: capacities[t] - quotas[t] for t in sorted(capacities) if capacities[t] > quotas[t]}
        total = sum(capacities[t] for t in open_)
        exact = {t: rest * capacities[t] / total for t in open_}
        given = {t: min(open_[t], math.floor(exact[t])) for t in open_}
        left = rest - sum(given.values())
        for t in sorted(open_, key=lambda t: (-(exact[t] - math.floor(exact[t])), t)):
            if left and given[t] < open_[t]:
                given[t] += 1
                left -= 1
        for t, n in given.items():
            quotas[t] += n
    return quotas


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def greedy_budget(clips: pd.DataFrame, vectors: np.ndarray, budget: int, weights: Sequence[float], sigma: float) -> list[str]:
    """Ids in order of choice: the largest gain in utility for a step of length, while any gain is above 0.

    Utility of a set: quality and novelty per step of the budget, coverage
    exp(-MMD^2) of all clips' kernel mean, and diversity (one less the mean
    scaled cosine over pairs). Gains of all clips come from running sums of
    kernel and cosine rows, so a round costs one row of each. Ties: score,
    shorter, id. ``clips`` has ``sample_id, length, quality, novelty, score``.
    """
    n = len(clips)
    wq, wc, wd, wn = weights
    length, quality, novelty, score = (clips[c].to_numpy(float) for c in ("length", "quality", "novelty", "score"))
    ids = clips["sample_id"].to_numpy()
    unit = _unit(vectors)
    d2 = lambda k: np.maximum(((vectors - vectors[k]) ** 2).sum(1), 0.0)
    kernel = lambda k: np.exp(-d2(k) / (2 * sigma**2))
    mean = np.array([kernel(k).mean() for k in range(n)])
    overall = mean.mean()
    chosen: list[int] = []
    free = np.ones(n, bool)
    k_sum, c_sum, inner, pairs, s_mean, s_quality, s_novelty, left, now = np.zeros(n), np.zeros(n), 0.0, 0.0, 0.0, 0.0, 0.0, float(budget), 0.0
    while True:
        fits = free & (length <= left)
        if not fits.any():
            break
        m = len(chosen) + 1
        mmd = np.maximum(overall + (inner + 2 * k_sum + 1.0) / m**2 - 2 * (s_mean + mean) / m, 0.0)
        spread = 1 - ((pairs + c_sum) / (m * (m - 1) / 2) + 1) / 2 if m > 1 else np.zeros(n)
        utility = wq * (s_quality + length * quality) / budget + wc * np.exp(-mmd) + wd * spread + wn * (s_novelty + length * novelty) / budget
        gain = np.where(fits, utility - now, -np.inf)
        order = np.lexsort((ids, length, -score, -gain / length))
        best = int(order[0])
        if gain[best] <= 0:
            break
        inner += 2 * k_sum[best] + 1.0
        pairs += c_sum[best]
        s_mean += mean[best]
        s_quality += length[best] * quality[best]
        s_novelty += length[best] * novelty[best]
        k_sum += kernel(best)
        c_sum += unit @ unit[best]
        left -= length[best]
        now = float(utility[best])
        free[best] = False
        chosen.append(best)
    return [str(ids[k]) for k in chosen]


#: Fixed values of the diverse selection: taken outright, kept as candidates, neighbours that count, and rows updated at once.
FIRST, CANDIDATES, NEIGHBOURS = 100, 100, 5


class _Penalties:
    """Each row's nearest chosen rows by a Gaussian kernel, and its score less the mean of their scores times similarity."""

    def __init__(self, scores: np.ndarray, vectors: np.ndarray, ids: np.ndarray, sigma: float, strength: float):
        self.scores, self.vectors, self.sigma, self.strength = scores, vectors, sigma, strength
        self.order = np.empty(len(ids), np.int64)
        self.order[np.argsort(ids)] = np.arange(len(ids))
        self.known = [dict[int, float]() for _ in ids]
        self.penalty, self.adjusted = np.zeros(len(ids)), scores.astype(float).copy()

    def see(self, rows: list[int], chosen: list[int]) -> None:
        """``rows`` learn of ``chosen``; each keeps its NEIGHBOURS most similar ones, ties by id."""
        if not rows or not chosen:
            return
        some = np.unique(chosen)
        for lo in range(0, len(rows), 512):
            part = np.array(rows[lo : lo + 512])
            apart = self.vectors[part, None] - self.vectors[some][None]
            alike = np.exp(-np.einsum("ijk,ijk->ij", apart, apart) / (2.0 * self.sigma * self.sigma))
            for row, found in zip(part.tolist(), alike, strict=True):
                known = self.known[row] | dict(zip(some.tolist(), found.tolist(), strict=True))
                best = sorted(known.items(), key=lambda x: (-x[1], self.order[x[0]]))[:NEIGHBOURS]
                self.known[row] = dict(best)
                self.penalty[row] = sum(s * self.scores[k] for k, s in best) / len(best)
                self.adjusted[row] = self.scores[row] - self.strength * self.penalty[row]


def diverse_fragments(scores: np.ndarray, vectors: np.ndarray, ids: Sequence[str], size: int, seed: int, strength: float = 1.0) -> pd.DataFrame:
    """``row, adjusted, penalty`` of ``size`` rows in order of choice: the best scores first, then by score less similarity to what is chosen.

    The FIRST best are taken as they are. Of the rest, CANDIDATES stand ready and
    learn of every choice; the others wait, and one of them joins after each
    choice, having caught up with a random part of the chosen (FIRST and the root
    of what is beyond, in all). The sequence depends on every earlier choice, so
    it runs on one machine over the rows that its caller bounds.
    """
    values, points, names = np.asarray(scores, float), np.asarray(vectors, float), np.asarray([str(i) for i in ids])
    if not FIRST <= size <= len(values):
        raise ValueError(f"size must be between {FIRST} and the number of rows")
    if len(set(names.tolist())) != len(names) or not np.isfinite(points).all() or not ((values >= 0) & (values <= 1)).all():
        raise ValueError("ids must be unique, vectors finite, and scores between 0 and 1")
    order = np.lexsort((names, -values)).tolist()
    top = points[order[:FIRST]]
    spread = np.linalg.norm(top[:, None] - top[None], axis=2)[np.triu_indices(FIRST, k=1)].mean()
    state, rng = _Penalties(values, points, names, max(float(spread), 1e-8), strength), np.random.default_rng(seed)
    rank = lambda k: (-state.adjusted[k], -values[k], names[k])
    chosen = order[:FIRST]
    out = [(k, float(values[k]), 0.0) for k in chosen]
    waiting = order[FIRST:]
    if len(chosen) < size:
        state.see(sorted(waiting), chosen)
    seen = {k: FIRST for k in waiting}
    waiting = [(rank(k), k) for k in waiting]
    heapq.heapify(waiting)
    ready = {heapq.heappop(waiting)[1] for _ in range(min(CANDIDATES, len(waiting)))}
    while len(chosen) < size:
        best = min(ready, key=rank)
        ready.remove(best)
        chosen.append(best)
        out.append((best, float(state.adjusted[best]), float(state.penalty[best])))
        if len(chosen) == size:
            break
        state.see(sorted(ready), [best])
        for k in ready:
            seen[k] += 1
        if waiting:
            new = heapq.heappop(waiting)[1]
            behind = max(0, math.ceil(FIRST + math.sqrt(len(chosen) - FIRST)) - seen[new])
            if behind:
                state.see([new], [chosen[int(k)] for k in rng.choice(len(chosen), size=behind, replace=False)])
            seen[new] += behind
            ready.add(new)
    return pd.DataFrame(out, columns=["row", "adjusted", "penalty"])


def diverse_stage(scores: DataFrame, vectors: DataFrame, score: str, percent: str | float, seed: int, most_rows: int = 200_000) -> DataFrame:
    """``sample_id, selection_order, adjusted, penalty``: the percentage's budget by ``diverse_fragments``.

    Scores and vectors must have the same ids, each once. The selection holds all
    rows on the driver, so there may be ``most_rows`` of them at most; more are an
    error, never dropped.
    """
    rows = scores.select("sample_id", F.col(score).cast("double").alias("score")).join(vectors.select("sample_id", "vec"), "sample_id", "full")
    n, bad = rows.agg(F.count(F.lit(1)), F.sum((F.col("score").isNull() | F.col("vec").isNull()).cast("int"))).first()
    if bad or n > most_rows:
        raise ValueError(f"{bad} rows have no score or no vector" if bad else f"{n} rows are more than {most_rows}")
    table = rows.orderBy("sample_id").toPandas()
    found = diverse_fragments(table["score"].to_numpy(), np.array(table["vec"].to_list(), float), table["sample_id"].to_list(), percent_budget(n, percent), seed)
    out = [(str(table["sample_id"][r]), k, float(a), float(p)) for k, (r, a, p) in enumerate(found.itertuples(index=False, name=None), 1)]
    return scores.sparkSession.createDataFrame(out, "sample_id string, selection_order long, adjusted double, penalty double")


def target_demos(ids: Sequence[str], task: str, count: int) -> list[str]:
    """``count`` of the sorted ids by a permutation that the task's name seeds."""
    if len(ids) < count:
        raise ValueError(f"{task}: {len(ids)} demonstrations, {count} are required")
    seed = int.from_bytes(hashlib.sha256(task.encode()).digest(), "big") % (2**31 - 1)
    return [str(x) for x in np.random.RandomState(seed).permutation(sorted(ids))[:count]]


def split_episodes(episodes: DataFrame, seed: int = 42, percent: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and validation episodes by the stable hash split; an error if either is empty though there are episodes."""
    marked = episodes.withColumn("v_", is_validation(F.lit(seed), F.col("episode_id"), F.lit(percent)))
    n, held = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("v_").cast("int")), F.lit(0))).first()
    if n and held in (0, n):
        raise ValueError("the split leaves one part empty")
    return marked.filter("NOT v_").drop("v_"), marked.filter("v_").drop("v_")


def bounded_simplex(gradient: np.ndarray, hessian: np.ndarray, low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    """Weights within bounds that sum to 1 and maximise g'w + w'Hw / 2, exactly: the best point over all sets of weights held at a bound.

    With some weights fixed, what is left is a quadratic on a plane; its
    stationary point, found by a solve (least squares if it is flat), counts if it lies within the bounds.
    """
    low, high, g, h = (np.asarray(x, float) for x in (low, high, gradient, hessian))
    n = len(low)
    if low.sum() > 1 + 1e-12 or high.sum() < 1 - 1e-12 or (low > high).any():
        raise ValueError("the bounds hold no weights that sum to 1")
    best, best_value = None, -np.inf
    for sides in itertools.product((0, 1, 2), repeat=n):
        sides = np.array(sides)
        free, w = np.flatnonzero(sides == 0), np.where(sides == 1, low, high)
        rest = 1.0 - w[sides > 0].sum()
        if not len(free):
            if abs(rest) > 1e-9:
                continue
        else:
            held = np.where(sides > 0, w, 0.0)
            k = len(free)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = h[np.ix_(free, free)], 1.0, 1.0
            right = np.append(-(g + h @ held)[free], rest)
            solved = np.linalg.lstsq(system, right, rcond=None)[0]
            if np.abs(system @ solved - right).max() > 1e-8:
                continue
            w = held.copy()
            w[free] = solved[:k]
        if (w < low - 1e-9).any() or (w > high + 1e-9).any():
            continue
        value = float(g @ w + w @ h @ w / 2)
        if value > best_value + 1e-12:
            best, best_value = np.where(np.abs(w) < 1e-12, 0.0, w), value
    return best


def full_greedy(mass: np.ndarray, rarity: np.ndarray, transition: np.ndarray, together: np.ndarray, edges: np.ndarray, penalties: np.ndarray, budget: int,
                tasks: Sequence | None = None, quotas: dict | None = None, weights: Sequence[float] = (4.0, 1.2, 0.5, 2.0, 2.0), start: Sequence[int] = (), eps: float = 1e-8) -> tuple[list[int], list[float]]:
    """Rows in order of choice by the largest gain in the whole objective, ties to the smallest, within task quotas; and the objective after each.

    ``mass[i, p]``: reliability times assignment; ``edges``: sequence (source,
    target); ``penalties``: similarity (a, b, penalty). Gains of all free rows are
    computed at once from the coverage: node, transition and co-occurrence terms
    by matrix products over prototypes, sequence and redundancy over a row's own edges.
    """
    n, m = mass.shape
    left, free, chosen = dict(quotas or {}), np.ones(n, bool), np.zeros(n, bool)
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b in edges:
        around[a].append((a, b))
        around[b].append((a, b))
    whole = sum((np.outer(mass[a], mass[b]) for a, b in edges), np.zeros((m, m)))
    alike: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, p in penalties:
        alike[int(a)].append((int(b), p))
        alike[int(b)].append((int(a), p))
    scale = max(sum(p for _, _, p in penalties), eps)
    cover, counts, redundancy = np.zeros(m), np.zeros((m, m)), 0.0
    pair = weights[1] * transition + weights[2] * together

    bound = np.log1p(whole) + eps
    walked = lambda k: weights[3] * float((transition * np.log1p(k) / bound).sum())

    def effect(k: int) -> tuple[np.ndarray, float]:
        """Sequence counts and redundancy with row k."""
        near = [(a, b) for a, b in around[k] if chosen[b if a == k else a]]
        return sum((np.outer(mass[a], mass[b]) for a, b in near), counts), redundancy + sum(p for o, p in alike[k] if chosen[o])

    out, values = [], []

    for forced in [*start, *[None] * (budget - len(start))]:
        open_ = np.flatnonzero(free) if tasks is None or quotas is None else np.array([k for k in np.flatnonzero(free) if left.get(tasks[k], 0) > 0], int)
        if forced is None and not len(open_):
            break
        if forced is None:
            roots = np.sqrt(np.maximum(cover, mass[open_]))
            gains = weights[0] * np.maximum(cover, mass[open_]) @ rarity + ((roots @ pair) * roots).sum(1)
            for j, k in enumerate(open_.tolist()):
                extra, r = effect(k)
                gains[j] += walked(extra) - weights[4] * r / scale
            best = int(open_[int(np.argmax(gains))])
        else:
            best = int(forced)
        counts, redundancy = effect(best)
        cover = np.maximum(cover, mass[best])
        chosen[best], free[best] = True, False
        if tasks is not None and quotas is not None:
            left[tasks[best]] -= 1
        root = np.sqrt(cover)
        out.append(best)
        values.append(float(weights[0] * rarity @ cover + root @ pair @ root + walked(counts) - weights[4] * redundancy / scale))
    return out, values


def exact_greedy(nodes: pd.DataFrame, masses: np.ndarray, rarity: np.ndarray, budget: int, quotas: dict | None = None) -> list[int]:
    """Nodes in order of choice: the largest gain in rarity-weighted coverage (ties to the smallest node), within task quotas.

    ``masses[i, p]``: reliability times assignment weight of row i of ``nodes`` (``node, task``).
    """
    cover, left, out = np.zeros(masses.shape[1]), dict(quotas or {}), []
    ids, tasks, free = nodes["node"].to_numpy(), nodes["task"].to_numpy(), np.ones(len(nodes), bool)
    while len(out) < budget:
        open_ = free & (np.array([left.get(t, 0) > 0 for t in tasks]) if quotas else True)
        if not open_.any():
            break
        gain = np.where(open_, (np.maximum(masses - cover, 0.0) * rarity).sum(1), -np.inf)
        best = int(np.lexsort((ids, -gain))[0])
        cover = np.maximum(cover, masses[best])
        free[best] = False
        if quotas:
            left[tasks[best]] -= 1
        out.append(int(ids[best]))
    return out


def covering_selection(rows: DataFrame, prototypes: Sequence, budget: int, quotas: dict | None = None, pool: int = 4096) -> list[int]:
    """``exact_greedy`` over ``node, task, mass`` rows (``mass``: an array, a number a prototype) of any number; the driver holds ``pool`` rows a task.

    A gain can only fall as the coverage grows, so the gain last computed bounds
    it from above. The pool holds the best rows of each open task by their gains
    under the present coverage (ties to the smaller node). A row of the pool is
    the choice if it comes before the last row that its own and every other full
    pool took in, by gain and then node, for all others come after that; if none
    does, the pools are drawn anew from all rows. So each pass over the table
    gives one choice at least, and mostly many.
    """
    rows = stored(rows.select(F.col("node").cast("long").alias("node"), F.col("task").cast("string").alias("key"), "mass"))
    total = rows.select(F.posexplode("mass").alias("p", "m")).groupBy("p").agg(F.sum("m").alias("m")).collect()
    if not total:
        return []
    rarity = np.zeros(len(prototypes))
    for p, m in total:
        rarity[p] = 1 / math.sqrt(m + 1e-8)
    rarity /= rarity.sum()
    left = {str(t): q for t, q in quotas.items()} if quotas else None
    cover, out, taken = np.zeros(len(prototypes)), [], {}

    def gains(mass: np.ndarray) -> np.ndarray:
        return (np.maximum(mass - cover, 0.0) * rarity).sum(1)

    def draw() -> tuple[pd.DataFrame, list[tuple[float, int]]]:
        """The pool, and where each full part of it ends: gain and node of its last row."""
        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for part in parts:
                part = part[[k not in taken and (left is None or left.get(t, 0) > 0) for k, t in zip(part["node"], part["key"], strict=True)]]
                if not len(part):
                    continue
                part = part.assign(gain=gains(np.array(part["mass"].to_list(), float)))
                held = part if held is None else pd.concat([held, part])
                held = held.sort_values(["gain", "node"], ascending=[False, True])
                held = held.groupby("key" if left is not None else np.zeros(len(held)), sort=False).head(pool)
            if held is not None:
                yield held

        found = rows.mapInPandas(best, "node long, key string, mass array<double>, gain double")
        order = (W.partitionBy("key") if left is not None else W.partitionBy(F.lit(0))).orderBy(F.desc("gain"), "node")
        found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= pool).toPandas().sort_values(["gain", "node"], ascending=[False, True])
        parts = found.groupby("key") if left is not None else [("", found)]
        return found.reset_index(drop=True), [(float(p["gain"].iloc[-1]), int(p["node"].iloc[-1])) for _, p in parts if len(p) >= pool]

    while len(out) < budget:
        table, ends = draw()
        if not len(table):
            break
        mass, nodes, keys, free = np.array(table["mass"].to_list(), float), table["node"].to_numpy(), table["key"].to_numpy(), np.ones(len(table), bool)
        fresh = True
        while len(out) < budget:
            open_ = free & (np.array([left[t] > 0 for t in keys]) if left is not None else True)
            if not open_.any():
                break
            gain = np.where(open_, gains(mass), -np.inf)
            best = int(np.lexsort((nodes, -gain))[0])
            place = (-gain[best], nodes[best])
            if not fresh and any(place > (-g, n) for g, n in ends):
                break
            fresh = False
            cover = np.maximum(cover, mass[best])
            free[best] = False
            taken[int(nodes[best])] = True
            if left is not None:
                left[keys[best]] -= 1
            out.append(int(nodes[best]))
    return out


def budget_selection(clips: DataFrame, budget: int, weights: Sequence[float], sigma: float) -> list[str]:
    """``greedy_budget`` over ``sample_id, length, quality, novelty, score, vec`` rows of any number, a pass over the table a choice.

    Kernel means come from ``similarity.mean_affinity``. Every task computes its
    rows' gains from the chosen rows, which are all that the driver sends, and
    gives its best one back.
    """
    from .similarity import mean_affinity

    wq, wc, wd, wn = weights
    rows = stored(clips.withColumn("id", F.monotonically_increasing_id()))
    rows = stored(rows.join(mean_affinity(rows, rows, sigma), "id"))
    overall = rows.agg(F.avg("affinity")).first()[0] or 0.0
    chosen: list[dict] = []
    inner = pairs = s_mean = s_quality = s_novelty = now = 0.0
    left = float(budget)
    schema = rows.select("id", "sample_id", "length", "quality", "novelty", "score", "vec", "affinity").withColumns({c: F.lit(0.0) for c in ("utility", "rate", "near", "cosine")}).schema

    while True:
        m, taken = len(chosen) + 1, {c["id"] for c in chosen}
        points = np.array([c["vec"] for c in chosen], float)

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = []
            for part in parts:
                part = part[(part["length"] <= left) & ~part["id"].isin(taken)]
                if not len(part):
                    continue
                x = np.array(part["vec"].to_list(), float)
                near, cosine = np.zeros(len(x)), np.zeros(len(x))
                for p in points:
                    near += np.exp(-((x - p) ** 2).sum(1) / (2 * sigma**2))
                    cosine += _unit(x) @ _unit(p[None])[0]
                length, mean = part["length"].to_numpy(float), part["affinity"].to_numpy()
                mmd = np.maximum(overall + (inner + 2 * near + 1.0) / m**2 - 2 * (s_mean + mean) / m, 0.0)
                spread = 1 - ((pairs + cosine) / (m * (m - 1) / 2) + 1) / 2 if m > 1 else np.zeros(len(x))
                utility = wq * (s_quality + length * part["quality"]) / budget + wc * np.exp(-mmd) + wd * spread + wn * (s_novelty + length * part["novelty"]) / budget
                part = part.assign(utility=utility, rate=(utility - now) / length, near=near, cosine=cosine)
                held.append(part.sort_values(["rate", "score", "length", "sample_id"], ascending=[False, False, True, True]).head(1))
            if held:
                yield pd.concat(held).sort_values(["rate", "score", "length", "sample_id"], ascending=[False, False, True, True]).head(1)[schema.names]

        found = rows.select(*schema.names[:8]).mapInPandas(best, schema).orderBy(F.desc("rate"), F.desc("score"), "length", "sample_id").first()
        if found is None or found["utility"] - now <= 0:
            break
        inner += 2 * found["near"] + 1.0
        pairs += found["cosine"]
        s_mean += found["affinity"]
        s_quality += found["length"] * found["quality"]
        s_novelty += found["length"] * found["novelty"]
        left -= found["length"]
        now = found["utility"]
        chosen.append(found.asDict())
    return [c["sample_id"] for c in chosen]


def random_selection(rows: DataFrame, budget: int, seed: int, start: DataFrame | None = None) -> DataFrame:
    """``sample_id``: the start set and clips by a hash of seed and id, ``budget`` in all."""
    first = start.select("sample_id").distinct() if start is not None else rows.select("sample_id").limit(0)
    rest = rows.select("sample_id").join(first, "sample_id", "left_anti")
    n = first.count()
    if n > budget:
        raise ValueError("the start set exceeds the budget")
    return first.unionByName(rest.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id")), "sample_id").limit(budget - n))


def batch_quotas(weights: Sequence[float], batch: int) -> list[int]:
    """Samples of each source in a batch: shares rounded down, the largest remainders get what is left, ties to the first."""
    total = sum(weights)
    exact = [batch * w / total for w in weights]
    out = [math.floor(x) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (-(exact[k] - out[k]), k))[: batch - sum(out)]:
        out[k] += 1
    return out


def interleaved(counts: Sequence[int]) -> list[int]:
    """Sources in turn, each as often as it counts; those that are used up are passed over."""
    return [k for turn in range(max(counts, default=0)) for k, n in enumerate(counts) if n > turn]


def interleaved_batches(steps: DataFrame, weights: Sequence[float], batch: int) -> DataFrame:
    """``step, slot, source, draw`` for every slot of every step's batch: exact quotas in turn, the turn beginning one later each step.

    ``draw`` counts a source's slots over all steps, so it names the sample to take from an endless order of that source.
    """
    quotas = batch_quotas(weights, batch)
    pattern = interleaved(quotas)
    earlier = [sum(p == pattern[k] for p in pattern[:k]) for k in range(batch)]
    at = (F.col("step") + F.col("slot")) % batch
    of = lambda values, k: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (k + 1).cast("int"))
    slots = steps.select(F.col("step").cast("long").alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch - 1).cast("long"))).alias("slot"))
    rows = slots.select("step", "slot", of(pattern, at).alias("source"), of(earlier, at).alias("own"), of(earlier, F.col("step") % batch).alias("skipped"), at.alias("at"))
    # within a batch the pattern is turned: what stands before the turn comes last
    before = sum((F.when((F.lit(k) < F.col("step") % batch) & (F.col("source") == p), 1).otherwise(0) for k, p in enumerate(pattern)), F.lit(0))
    quota = of(quotas, F.col("source"))
    place = F.when(F.col("at") >= F.col("step") % batch, F.col("own") - before).otherwise(F.col("own") + quota - before)
    return rows.select("step", "slot", "source", (F.col("step") * quota + place).cast("long").alias("draw"))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights of standardised ridge regression, in the original units."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return np.concatenate([[y.mean() - mean @ w], w])


def features(weights: np.ndarray, quadratic: bool) -> np.ndarray:
    """The columns, and with ``quadratic`` their squares and products."""
    if not quadratic:
        return weights
    n = weights.shape[1]
    return np.column_stack([weights, *[weights[:, i] * weights[:, j] for i in range(n) for j in range(i, n)]])


def fit_response(weights: np.ndarray, y: np.ndarray, alphas: Sequence[float] | None = None) -> dict:
    """The response surface with the least leave-one-out error over orders and penalties (ties: larger penalty, linear order)."""
    alphas = np.logspace(-6, 3, 38) if alphas is None else np.asarray(alphas)
    best = None
    for quadratic in (False, True):
        x = features(weights, quadratic)
        for alpha in sorted(alphas, reverse=True):
            errors = np.array([y[i] - np.concatenate([[1.0], x[i]]) @ ridge(np.delete(x, i, 0), np.delete(y, i), alpha) for i in range(len(y))])
            rmse = float(np.sqrt((errors**2).mean()))
            if best is None or rmse < best["loo_rmse"] - 1e-15:
                best = {"quadratic": quadratic, "alpha": float(alpha), "loo_rmse": rmse, "weights": ridge(x, y, alpha)}
    return best


def nested_errors(weights: np.ndarray, y: np.ndarray, alphas: Sequence[float] | None = None) -> np.ndarray:
    """For each row the error of the surface that is fitted, order and penalty included, without it."""
    out = []
    for k in range(len(y)):
        best = fit_response(np.delete(weights, k, 0), np.delete(y, k), alphas)
        out.append(y[k] - np.concatenate([[1.0], features(weights[k : k + 1], best["quadratic"])[0]]) @ best["weights"])
    return np.array(out)
