"""Small histogram-based regression trees, gradient boosting, isotonic calibration and lasso logistic regression in numpy.

They run on the driver over a bounded sample of labelled rows; see the operators that use them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Node:
    """A split (x[feature] <= cut goes left) or, with feature -1, a leaf."""

    feature: int
    cut: float
    left: int
    right: int
    value: float


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Cut points for each column: midpoints between distinct quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, BINS), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.int64)


def fit_tree(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rows: np.ndarray, columns: np.ndarray, least: float, ridge: float) -> list[Node]:
    """One tree for the second-order loss grad * f + hess * f**2 / 2, grown to `depth` over the given rows and columns."""
    nodes: list[Node] = []

    def grow(at: np.ndarray, left: int) -> int:
        g, h = grad[at].sum(), hess[at].sum()
        nodes.append(Node(-1, 0.0, -1, -1, float(-g / (h + ridge))))
        me = len(nodes) - 1
        if not left or len(at) < 2:
            return me
        best = (1e-9, -1, 0)
        for f in columns:
            b = bins[at, f]
            gs = np.cumsum(np.bincount(b, grad[at], BINS))[:-1]
            hs = np.cumsum(np.bincount(b, hess[at], BINS))[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(hs < least) | (h - hs < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0] and k < len(edges[f]):
                best = (gain[k], int(f), k)
        if best[1] < 0:
            return me
        go = bins[at, best[1]] <= best[2]
        nodes[me].feature, nodes[me].cut = best[1], float(edges[best[1]][best[2]])
        nodes[me].left = grow(at[go], left - 1)
        nodes[me].right = grow(at[~go], left - 1)
        return me

    grow(rows, depth)
    return nodes


def apply_tree(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, at = todo.pop()
        n = nodes[k]
        if n.feature < 0:
            out[at] = n.value
        else:
            go = x[at, n.feature] <= n.cut
            todo += [(n.left, at[go]), (n.right, at[~go])]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, seed: int, share: float = 0.7) -> tuple[float, list[list[Node]]]:
    """Logistic gradient boosting: the intercept and the trees (leaf values already shrunk)."""
    edges = edges_of(x)
    bins = binned(x, edges)
    draw = np.random.default_rng(seed)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    f, out = np.full(len(y), start), []
    for _ in range(trees):
        q = sigmoid(f)
        rows = np.sort(draw.permutation(len(y))[: max(2, int(share * len(y)))])
        columns = np.sort(draw.permutation(x.shape[1])[: max(1, int(0.8 * x.shape[1]))])
        tree = fit_tree(bins, edges, q - y, np.maximum(q * (1 - q), 1e-6), depth, rows, columns, 0.5, 1.0)
        for n in tree:
            n.value *= rate
        f = f + apply_tree(tree, x)
        out.append(tree)
    return start, out


def score_trees(model: tuple[float, list[list[Node]]], x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model[0])
    for tree in model[1]:
        f += apply_tree(tree, x)
    return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on score: points (x, p) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = [p for b in blocks for p in (b[2], b[3])]
    ps = [p for b in blocks for p in (b[0], b[0])]
    return np.array(xs), np.array(ps)


def rules_of(trees: list[list[Node]]) -> list[tuple[tuple[int, str, float], ...]]:
    """The conditions on the way to each inner and outer node, as conjunctions ((feature, '<=' or '>', cut), ...), without repeats."""
    found = {}
    for nodes in trees:
        todo = [(0, ())]
        while todo:
            k, path = todo.pop()
            if path:
                tight = {}
                for f, op, cut in path:
                    old = tight.get((f, op))
                    tight[f, op] = cut if old is None else (min if op == "<=" else max)(old, cut)
                found[tuple(sorted((f, op, cut) for (f, op), cut in tight.items()))] = None
            n = nodes[k]
            if n.feature >= 0:
                todo += [(n.left, (*path, (n.feature, "<=", n.cut))), (n.right, (*path, (n.feature, ">", n.cut)))]
    return list(found)


def rule_matrix(rules, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, op, cut in rule:
            out[:, j] *= x[:, f] <= cut if op == "<=" else x[:, f] > cut
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Minimises the mean logistic loss plus penalty * |w| (not the intercept) by accelerated proximal gradient steps."""
    n, m = a.shape
    mean = a.mean(0)
    spread = np.maximum(a.std(0), 0.05)
    z = (a - mean) / spread
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = back_b = float(np.log(p / (1 - p)))
    w = back_w = np.zeros(m)
    v = np.random.default_rng(0).normal(size=m)
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    size = max(0.25 * (float(np.linalg.norm(z @ v) ** 2) / n + 1), 1e-6)
    t = 1.0
    for _ in range(steps):
        r = sigmoid(z @ back_w + back_b) - y
        new_w = back_w - (z.T @ r) / n / size
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - penalty / size, 0)
        new_b = back_b - r.mean() / size
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        back_w, back_b = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    w = w / spread
    return float(b - w @ mean), w
