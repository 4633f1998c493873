"""Random forests without a limit of depth, grown in two ways.

While a node's rows are too many for a task, its split is found over the cluster: tasks sum class weights by (tree, node,
feature, bin), the sums are shuffled by tree, node and feature and added up, and one row a node comes to the driver; so the
upper levels of all trees take a pass a level. A node whose rows fit a task (``LOCAL`` values) is brought to one, which grows
the subtree below it until its leaves are pure or cannot be divided. Trees of small tables are grown so from their roots.

A row counts in a tree as often as a Poisson variable of mean 1 says, which is drawn from a hash of the row's number and the
tree: no table of resamples is kept, and a task that runs again draws the same. A node looks at the square root of all features,
drawn from a hash of its tree and path, and goes on to others while none of them divides it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.boosting import bin_edges, binned
from tessera.sources.shared import Scratch, spread, store

TREES, BINS = 300, 255
LOCAL = 1 << 22  # values, of one byte each, of a node that one task grows on
GROUP = 20  # trees whose upper levels are grown in the same passes
SPREAD = 50_000  # rows from which on a small file is spread over all cores
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Even 64-bit values from any."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def times_drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by number) counts in a tree."""
    with np.errstate(over="ignore"):
        key = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0x632BE59BD9B4E019 + seed & 0xFFFFFFFFFFFFFFFF)
    return np.searchsorted(_POISSON, _mixed(_mixed(key)) / 2.0**64, side="right")


def feature_order(seed: int, tree: int, path: str, d: int) -> np.ndarray:
    """The order in which a node looks at features."""
    return np.random.default_rng([seed, tree, len(path), int(f"1{path}", 2)]).permutation(d)


def best_cut(counts: np.ndarray) -> tuple[float, int] | None:
    """Score and cut of the best division of (bins, classes) weights of a feature: the sum over both sides of squares over weight.

    The larger it is, the smaller the Gini impurity. None if one side is always empty.
    """
    left = np.cumsum(counts, axis=0)
    right = left[-1] - left
    n, m = left.sum(1), right.sum(1)
    at = np.flatnonzero((n > 0) & (m > 1e-12 * left[-1].sum()) & (counts.sum(1) > 0))
    if not len(at):
        return None
    score = (left[at] ** 2).sum(1) / n[at] + (right[at] ** 2).sum(1) / m[at]
    k = int(np.argmax(np.round(score, 9)))
    return float(score[k]), int(at[k])


@dataclass
class Grown:
    """A tree: of each node its feature (-1 for a leaf), cut and first child (the second follows), and the class shares of its leaves."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    shares: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := self.feature[node] >= 0).any():
            high = bins[rows, np.maximum(self.feature[node], 0)] > self.cut[node]
            node = np.where(inner, self.child[node] + high, node)
        return node


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, seed: int, tree: int, path: str = "") -> Grown:
    """The whole subtree of these rows, whose weights are all positive; ``path`` is that of its root."""
    d = bins.shape[1]
    few = max(1, int(math.sqrt(d)))
    feature, cut, child, shares = [-1], [0], [0], [None]
    todo = [(0, np.arange(len(y)), path)]
    while todo:
        node, rows, at = todo.pop()
        own = np.bincount(y[rows], weight[rows], minlength=k)
        shares[node] = own / max(own.sum(), 1e-300)
        if (own > 0).sum() < 2:
            continue
        best, looked = None, 0
        for f in feature_order(seed, tree, at, d):
            if looked >= few and best is not None:
                break
            looked += 1
            column = bins[rows, f].astype(np.int64)
            low = column.min()
            found = best_cut(np.bincount((column - low) * k + y[rows], weight[rows], minlength=(column.max() - low + 1) * k).reshape(-1, k))
            if found and (best is None or found[0] > best[0]):
                best = (found[0], int(f), found[1] + int(low))
        if best is None:
            continue
        first = len(feature)
        feature[node], cut[node], child[node] = best[1], best[2], first
        high = bins[rows, best[1]] > best[2]
        for side, part in (("0", rows[~high]), ("1", rows[high])):
            todo.append((len(feature), part, at + side))
            feature.append(-1), cut.append(0), child.append(0), shares.append(None)
    return Grown(np.array(feature, np.int32), np.array(cut, np.int16), np.array(child, np.int32), np.array(shares, np.float32))


_PACKED = "row bigint, y int, weight double, bins binary"


def _read(batch, d: int):
    """Number, class, weight and bins of the rows of a batch."""
    flat = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
    return (np.asarray(batch.column(c)) for c in ("row", "y", "weight")), flat


def _members(upper: dict[int, Grown], asked: dict[int, dict[int, str]], d: int, seed: int):
    """The rows of nodes ``asked`` (by tree: number and path), packed: a row a node and batch."""

    def run(batches):
        names, types = ["tree", "path", "y", "weight", "bins"], [pa.int32(), pa.string(), *[pa.binary()] * 3]
        for batch in batches:
            (rows, y, weight), bins = _read(batch, d)
            out = []
            for tree, nodes in asked.items():
                times = times_drawn(rows, tree, seed)
                at = upper[tree].leaf_of(bins)
                for node, path in nodes.items():
                    own = np.flatnonzero((at == node) & (times * weight > 0))
                    if len(own):
                        out.append((tree, path, y[own].astype("<i4").tobytes(), (weight * times)[own].astype("<f8").tobytes(), bins[own].tobytes()))
                if len(out) >= 64:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


_GROWN = "tree int, path string, feature binary, cut binary, child binary, shares binary"


def _subtrees(k: int, d: int, seed: int):
    """Members in order of tree and path, to the subtree of each node."""

    def run(batches):
        key, held = None, []

        def done():
            read = lambda c, kind: np.frombuffer(b"".join(h[c] for h in held), kind)
            found = grow(read(2, np.uint8).reshape(-1, d), read(0, "<i4").astype(np.int64), read(1, "<f8"), k, seed, *key)
            columns = [[key[0]], [key[1]], [found.feature.tobytes()], [found.cut.tobytes()], [found.child.tobytes()], [found.shares.tobytes()]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.string(), *[pa.binary()] * 4], strict=True)], [x.split(" ")[0] for x in _GROWN.split(", ")])

        for batch in batches:
            for tree, path, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "y", "weight", "bins")), strict=True):
                if (tree, path) != key:
                    if held:
                        yield done()
                    key, held = (tree, path), []
                held.append(row)
        if held:
            yield done()

    return run


def _histograms(upper: dict[int, Grown], asked: dict[int, dict[int, str]], features: dict[tuple[int, str], list[int]], k: int, d: int, seed: int):
    """Class weights of a partition by tree, path, feature and bin, and how many rows there are."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            (rows, y, weight), bins = _read(batch, d)
            for tree, nodes in asked.items():
                times = times_drawn(rows, tree, seed)
                at = upper[tree].leaf_of(bins)
                for node, path in nodes.items():
                    own = np.flatnonzero((at == node) & (times > 0))
                    for f in features[tree, path]:
                        key = (tree, path, f)
                        if key not in sums:
                            sums[key] = np.zeros((257, k))
                        sums[key][:256] += np.bincount(bins[own, f].astype(np.int64) * k + y[own], (weight * times)[own], minlength=256 * k).reshape(256, k)
                        sums[key][256, 0] += len(own)
        types = [pa.int32(), pa.string(), pa.int32(), pa.binary()]
        rows_ = [(*key, s.astype("<f8").tobytes()) for key, s in sums.items()]
        for lo in range(0, len(rows_), 256):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows_[lo : lo + 256], strict=True), types, strict=True)], ["tree", "path", "feature", "sums"])

    return run


def _cuts(k: int):
    """Sums in order of tree, path and feature, to the best cut of each with the rows' class weights and number."""

    def run(batches):
        key, sums = None, None
        names = ["tree", "path", "feature", "score", "cut", "n", "weights"]

        def done():
            found = best_cut(sums[:256])
            columns = [[key[0]], [key[1]], [key[2]], [found and found[0]], [found and found[1]], [int(sums[256, 0])], [sums[:256].sum(0).tolist()]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.float64())], strict=True)], names)

        for batch in batches:
            for tree, path, f, packed in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "feature", "sums")), strict=True):
                if (tree, path, f) != key:
                    if key:
                        yield done()
                    key, sums = (tree, path, f), np.zeros((257, k))
                sums = sums + np.frombuffer(packed, "<f8").reshape(257, k)
        if key:
            yield done()

    return run


def _joined(upper: Grown, below: dict[int, Grown]) -> Grown:
    """A tree whose leaves (by number) are replaced by subtrees."""
    feature, cut, child, shares = upper.feature.copy(), upper.cut.copy(), upper.child.copy(), upper.shares.copy()
    parts, size = [[feature], [cut], [child], [shares]], len(feature)
    for node, sub in below.items():
        # the subtree's root takes the leaf's place, its other nodes follow behind; children are numbered from there
        shift = size - 1
        feature[node], cut[node], child[node], shares[node] = sub.feature[0], sub.cut[0], sub.child[0] + shift, sub.shares[0]
        for whole, own in zip(parts, (sub.feature[1:], sub.cut[1:], sub.child[1:] + shift, sub.shares[1:]), strict=True):
            whole.append(own)
        size += len(sub.feature) - 1
    return Grown(*(np.concatenate(p) for p in parts))


@dataclass
class Forest:
    """Edges of the bins and the trees. Its size follows the leaves, which for noisy classes are as many as rows."""

    edges: list[list[float]]
    trees: list[Grown]
    classes: int

    def proba(self, values: np.ndarray) -> np.ndarray:
        bins, out = binned(values, self.edges), np.zeros((len(values), self.classes))
        for tree in self.trees:
            out += tree.shares[tree.leaf_of(bins)]
        return out / max(len(self.trees), 1)

    def probabilities(self, features: str):
        """A column of arrays of probabilities from a column of arrays of numbers."""

        @F.arrow_udf("array<double>")
        def said(column: pa.Array) -> pa.Array:
            values = np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)
            return pa.array(list(self.proba(values)) if len(column) else [], pa.list_(pa.float64()))

        return said(features)

    def save(self, path) -> None:
        sizes = np.array([len(t.feature) for t in self.trees])
        arrays = {c: np.concatenate([getattr(t, c) for t in self.trees]) for c in ("feature", "cut", "child", "shares")}
        np.savez_compressed(path, sizes=sizes, edges=np.concatenate([np.array(e, float) for e in self.edges] or [np.zeros(0)]), widths=np.array([len(e) for e in self.edges]), **arrays)

    @staticmethod
    def load(path) -> Forest:
        with np.load(path, allow_pickle=False) as held:
            at = np.cumsum(held["sizes"])[:-1]
            parts = [np.split(held[c], at) for c in ("feature", "cut", "child", "shares")]
            edges = [e.tolist() for e in np.split(held["edges"], np.cumsum(held["widths"])[:-1])]
            return Forest(edges, [Grown(*p) for p in zip(*parts, strict=True)], held["shares"].shape[1])


def _upper_levels(rows: DataFrame, trees: list[int], n: int, k: int, d: int, seed: int, local: int) -> tuple[dict[int, Grown], dict[int, dict[int, str]]]:
    """Of each tree its upper levels, and the leaves of these (number and path) whose rows fit a task."""
    leaf = lambda: Grown(np.array([-1], np.int32), np.array([0], np.int16), np.array([0], np.int32), np.zeros((1, k), np.float32))
    upper, few = {t: leaf() for t in trees}, {t: {} for t in trees}
    size = {(t, ""): n for t in trees}
    asked = {t: {0: ""} for t in trees}
    tried: dict[tuple[int, str], int] = {}
    step = max(1, int(math.sqrt(d)))
    while True:
        for t in trees:
            for node, path in list(asked[t].items()):
                if size[t, path] * d <= local:
                    few[t][node] = asked[t].pop(node)
        due = {t: nodes for t, nodes in asked.items() if nodes}
        if not due:
            return upper, few
        looked = {(t, p): [int(f) for f in feature_order(seed, t, p, d)[tried.get((t, p), 0) : tried.get((t, p), 0) + step]] for t, nodes in due.items() for p in nodes.values()}
        sums = rows.mapInArrow(_histograms(upper, due, looked, k, d, seed), "tree int, path string, feature int, sums binary")
        keys = ["tree", "path", "feature"]
        cuts = sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cuts(k), "tree int, path string, feature int, score double, cut int, n bigint, weights array<double>")
        best = F.max_by(F.struct("score", "feature", "cut"), F.coalesce(F.col("score"), F.lit(-1.0))).alias("s")
        found = {(r["tree"], r["path"]): r for r in cuts.groupBy("tree", "path").agg(best, F.max("n").alias("n"), F.first("weights").alias("weights")).collect()}  # a row a node
        for t, nodes in due.items():
            for node, path in list(nodes.items()):
                r = found.get((t, path))
                own = np.array(r["weights"]) if r else np.zeros(k)
                if (own > 0).sum() < 2 or r["s"]["score"] is None and tried.get((t, path), 0) + step >= d:
                    upper[t].shares[node] = own / max(own.sum(), 1e-300)  # pure, or not to be divided: a leaf, whatever its size
                    del asked[t][node]
                    continue
                if r["s"]["score"] is None:
                    tried[t, path] = tried.get((t, path), 0) + step
                    continue
                tree, first = upper[t], len(upper[t].feature)
                tree.feature[node], tree.cut[node], tree.child[node] = r["s"]["feature"], r["s"]["cut"], first
                upper[t] = Grown(np.append(tree.feature, [-1, -1]).astype(np.int32), np.append(tree.cut, [0, 0]).astype(np.int16), np.append(tree.child, [0, 0]).astype(np.int32), np.vstack((tree.shares, np.zeros((2, k), np.float32))))
                del asked[t][node]
                for side in (0, 1):
                    asked[t][first + side] = path + str(side)
        sizes = rows.mapInArrow(_sizes(upper, {t: nodes for t, nodes in asked.items() if nodes}, d, seed), "tree int, path string, n bigint").groupBy("tree", "path").agg(F.sum("n").alias("n"))
        if any(asked.values()):
            size |= {(r["tree"], r["path"]): r["n"] for r in sizes.collect()}


def _sizes(upper: dict[int, Grown], asked: dict[int, dict[int, str]], d: int, seed: int):
    def run(batches):
        for batch in batches:
            (rows, _, _), bins = _read(batch, d)
            out = []
            for tree, nodes in asked.items():
                at = upper[tree].leaf_of(bins)[times_drawn(rows, tree, seed) > 0]
                out += [(tree, path, int((at == node).sum())) for node, path in nodes.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["tree", "path", "n"])

    return run


def fit_forest(rows: DataFrame, k: int, seed: int = 0, trees: int = TREES, bins: int = BINS, local: int = LOCAL) -> Forest:
    """Fit on rows with y (0 to k - 1), weight and features (arrays of one length)."""
    head = rows.select(F.size("features")).first()
    if head is None:
        return Forest([], [], k)
    d, edges = head[0], bin_edges(rows, head[0], bins)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                own = [b.tobytes() for b in binned(np.array(batch.column("features").to_pylist(), dtype=float), edges)]
                yield pa.record_batch([batch.column("row"), batch.column("y"), batch.column("weight"), pa.array(own, pa.binary())], ["row", "y", "weight", "bins"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"), "features")
    with Scratch():
        packed = store(numbered.mapInArrow(pack, _PACKED), "forest").df
        n = packed.count()
        if n > SPREAD:
            packed = store(spread(packed), "forest").df
        done: dict[int, Grown] = {}
        for lo in range(0, trees, GROUP if n * d > local else trees):
            group = list(range(lo, min(trees, lo + (GROUP if n * d > local else trees))))
            upper, few = _upper_levels(packed, group, n, k, d, seed, local)
            members = packed.mapInArrow(_members(upper, few, d, seed), "tree int, path string, y binary, weight binary, bins binary").repartition("tree", "path").sortWithinPartitions("tree", "path")
            below: dict[int, dict[str, Grown]] = {t: {} for t in group}
            for r in members.mapInArrow(_subtrees(k, d, seed), _GROWN).toLocalIterator():
                below[r["tree"]][r["path"]] = Grown(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["cut"], np.int16), np.frombuffer(r["child"], np.int32), np.frombuffer(r["shares"], np.float32).reshape(-1, k))
            for t in group:
                done[t] = _joined(upper[t], {node: below[t][path] for node, path in few[t].items() if path in below[t]})
    return Forest(edges, [done[t] for t in range(trees)], k)
