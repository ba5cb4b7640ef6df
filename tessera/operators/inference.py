"""Chain, grid and Gaussian-graph inference. Components are independent, so each is one group of a grouped Arrow UDF; a group above its size limit is refused with a clear error, not sampled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Variables of a chain or graph that one task may solve.
LIMIT = 100_000


def _sized(n: int) -> None:
    if n > LIMIT:
        raise ValueError(f"a component has {n} variables; the limit is {LIMIT}")


def viterbi(unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, float]:
    """Least-cost states of a chain: unary (variables, states), pair (states, states) between neighbours; ties go to the lower state."""
    best, back = unary[0], []
    for u in unary[1:]:
        step = best[:, None] + pair
        back.append(step.argmin(axis=0))
        best = step.min(axis=0) + u
    states = [int(best.argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1]), float(best.min())


def chain_labels(costs: DataFrame, difference: float) -> DataFrame:
    """costs (chain, var, state, cost): (chain, var, state, total) of the best labelling when neighbours of different states cost `difference`; missing costs are zero."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf.pivot_table(index="var", columns="state", values="cost", aggfunc="sum", fill_value=0.0)
        _sized(len(u))
        k = u.shape[1]
        states, total = viterbi(u.to_numpy(float), difference * (1 - np.eye(k)))
        return pd.DataFrame({"chain": pdf["chain"].iloc[0], "var": u.index, "state": u.columns.to_numpy()[states], "total": total})

    return costs.groupBy("chain").applyInPandas(solve, "chain long, var long, state long, total double")


def pair_different(states: int, different: float, same: float = 0.0, offset: int = 0) -> np.ndarray:
    """Costs by whether the state before, moved by the offset, is the one after."""
    a, b = np.indices((states, states))
    return np.where(a == b + offset, same, different).astype(float)


def pair_linear(states: int, mult: float, offset: float = 0.0, scale: float = 1.0, cap: float = np.inf) -> np.ndarray:
    """Costs by the distance of the state before from a line in the one after, up to a cap."""
    a, b = np.indices((states, states))
    return np.minimum(cap, mult * np.abs(a - (b * scale + offset)))


def pair_ordered(states: int, steps: list[float]) -> np.ndarray:
    """States never go back; steps: the cost of staying, of going on by one, by two and so on, further being impossible."""
    a, b = np.indices((states, states))
    by = np.append(np.asarray(steps, float), np.inf)
    return np.where(b < a, np.inf, by[np.clip(b - a, 0, len(steps))])


def min_marginals(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """For every variable and state, the cost of the best labelling that has it."""
    ahead, back = [unary[0]], [np.zeros(unary.shape[1])]
    for u in unary[1:]:
        ahead.append((ahead[-1][:, None] + pair).min(axis=0) + u)
    for u in unary[:0:-1]:
        back.append((pair + (u + back[-1])[None, :]).min(axis=1))
    return np.stack(ahead) + np.stack(back[::-1])


def chain_min_marginals(costs: DataFrame, pair: np.ndarray) -> DataFrame:
    """costs (chain, var, state, cost), states from 0: (chain, var, state, total) of the best labelling through each state, for any matrix of costs between neighbours."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf.pivot_table(index="var", columns="state", values="cost", aggfunc="sum", fill_value=0.0).reindex(columns=range(len(pair)), fill_value=0.0)
        _sized(len(u))
        total = min_marginals(u.to_numpy(float), pair)
        return pd.DataFrame({"chain": pdf["chain"].iloc[0], "var": np.repeat(u.index, len(pair)), "state": np.tile(np.arange(len(pair)), len(u)), "total": total.ravel()})

    return costs.groupBy("chain").applyInPandas(solve, "chain long, var long, state long, total double")


def gaussian_marginals(terms: DataFrame) -> DataFrame:
    """Means and variances of Gaussian graphs: terms (graph, a, b, precision, potential), a = b for a node's own term. Solved by belief propagation on trees, exactly by elimination where it does not settle."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        _sized(len(nodes))
        at = at.reshape(-1, 2)
        own = at[:, 0] == at[:, 1]
        diagonal, h = np.zeros(len(nodes)), np.zeros(len(nodes))
        np.add.at(diagonal, at[own, 0], pdf["precision"].to_numpy()[own])
        np.add.at(h, at[own, 0], pdf["potential"].fillna(0).to_numpy()[own])
        i, j, off = at[~own, 0], at[~own, 1], pdf["precision"].to_numpy()[~own]
        mean, var = propagate(diagonal, h, i, j, off)
        if mean is None:
            m = np.diag(diagonal)
            np.add.at(m, (i, j), off)
            np.add.at(m, (j, i), off)
            cov = np.linalg.inv(m)
            mean, var = cov @ h, np.diag(cov)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": nodes, "mean": mean, "var": var})

    return terms.groupBy("graph").applyInPandas(solve, "graph long, node long, mean double, var double")


def propagate(diagonal, h, i, j, off, rounds: int = 200):
    """Gaussian belief propagation, all messages at once; exact when the graph is a forest. (None, None) if it has cycles or does not settle."""
    n, m = len(diagonal), len(off)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i, j):
        a, b = find(a), find(b)
        if a == b:
            return None, None
        root[a] = b
    src, dst, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([off, off])
    p, q = np.zeros(2 * m), np.zeros(2 * m)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    for _ in range(max(rounds, n + 1)):
        tp, tq = diagonal + np.bincount(dst, p, n), h + np.bincount(dst, q, n)
        cp, cq = tp[src] - p[back], tq[src] - q[back]
        new_p, new_q = -w * w / cp, -w * cq / cp
        if np.allclose(new_p, p, rtol=1e-13, atol=0) and np.allclose(new_q, q, rtol=1e-13, atol=1e-300):
            break
        p, q = new_p, new_q
    tp = diagonal + np.bincount(dst, p, n)
    return (h + np.bincount(dst, q, n)) / tp, 1 / tp


def max_flow(edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, set[int]]:
    """Flow value and the source side of a least cut, by shortest augmenting levels."""
    capacity: list[float] = []
    out: dict[int, list[int]] = {source: [], sink: []}
    head: list[int] = []
    for a, b, c in edges:
        for x, y, k in ((a, b, c), (b, a, 0.0)):
            out.setdefault(x, []).append(len(head))
            out.setdefault(y, [])
            head.append(y)
            capacity.append(k)
    total = 0.0
    while True:
        level, queue = {source: 0}, [source]
        for x in queue:
            for e in out[x]:
                if capacity[e] > 1e-12 and head[e] not in level:
                    level[head[e]] = level[x] + 1
                    queue.append(head[e])
        if sink not in level:
            return total, set(level)
        place = dict.fromkeys(out, 0)
        while True:  # one path of the level graph after another
            path, x = [], source
            while x != sink:
                while place[x] < len(out[x]):
                    e = out[x][place[x]]
                    if capacity[e] > 1e-12 and level.get(head[e], -1) == level[x] + 1:
                        break
                    place[x] += 1
                if place[x] < len(out[x]):
                    path.append(e)
                    x = head[e]
                elif not path:
                    break
                else:
                    e = path.pop()
                    x = head[e ^ 1]
                    place[x] += 1
            if x != sink:
                break
            push = min(capacity[e] for e in path)
            for e in path:
                capacity[e] -= push
                capacity[e ^ 1] += push
            total += push


def binary_cut(terms: DataFrame) -> DataFrame:
    """Least-cost 0/1 labels: terms (graph, a, b, cost0, cost1); a = b gives a node's costs of 0 and 1, else cost0 is paid when the two differ. (graph, node, label, total)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["a", "b"]].to_numpy())
        _sized(len(nodes))
        source, sink = int(nodes.min()) - 2, int(nodes.min()) - 1
        edges, base = [], 0.0
        for a, b, c0, c1 in pdf[["a", "b", "cost0", "cost1"]].fillna(0).itertuples(index=False):
            if a == b:
                low = min(c0, c1)
                base += low
                edges += [(source, a, c1 - low), (a, sink, c0 - low)]
            else:
                edges += [(a, b, c0), (b, a, c0)]
        value, side = max_flow(edges, source, sink)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": nodes, "label": [0 if n in side else 1 for n in nodes], "total": base + value})

    return terms.groupBy("graph").applyInPandas(solve, "graph long, node long, label int, total double")
