"""Gradient boosting of trees on binned columns, for any number of classes.

Every round fits one tree a class to the gradients of the softmax loss. Tasks walk their rows down the trees as far as these
are known and sum gradients, hessians and rows by (class, node, feature, bin). These sums are shuffled by class, node and
feature and added up, the best cut of each feature is found, and one row a node comes to the driver. What is held does not
grow with the rows: a task holds the sums of the nodes asked for, the driver the trees.

Trees grow leaf by leaf, the leaf of the largest gain first, up to ``leaves``. Which leaf that is depends on the gains of its
children, so a pass asks for all nodes that the growth so far would split, and growth is replayed until it meets no node
whose split is unknown: a few passes a round instead of one a leaf, with the same trees. A node of few rows is brought to one
task, which finds all splits that growth could make below it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, spread, store

ROUNDS, RATE, LEAVES, LEAST_ROWS, BINS = 100, 0.1, 31, 20, 255
PIECES = 256  # of a feature's values, for exact ranks
LEAST_HESSIAN = 1e-3
WRITTEN = 8  # rounds after which scores are written
LOCAL = 1 << 22  # values, of one byte each, of a node that one task finishes
SPREAD = 50_000  # rows from which on a small file is spread over all cores


def bin_edges(rows: DataFrame, d: int, bins: int = BINS) -> list[list[float]]:
    """Of each of d features: the different values at equal steps of rank, the upper edges of all bins but the last."""
    steps = "array(" + ", ".join(f"{k / bins!r}D" for k in range(1, bins)) + ")"
    found = rows.select(*(F.expr(f"percentile_approx(cast(features[{j}] AS double), {steps}, {max(10_000, 40 * bins)})").alias(f"f{j}") for j in range(d))).first()
    return [sorted({float(v) for v in found[j]}) if found[j] is not None else [] for j in range(d)]


def _counted(d: int, near: list[list[float]]):
    """Rows with features to how often each feature has each value, and in which piece the value is."""

    def run(batches):
        for batch in batches:
            flat = batch.column("features").flatten()
            have = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
            values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            own = [np.unique(values[have[:, j], j], return_counts=True) for j in range(d)]
            feature = np.repeat(np.arange(d), [len(x) for x, _ in own])
            piece = np.concatenate([np.searchsorted(np.array(near[j]), x, side="left") for j, (x, _) in enumerate(own)])
            columns = (feature.astype(np.int32), piece.astype(np.int32), np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own]).astype(np.int64))
            yield pa.record_batch([pa.array(c) for c in columns], ["feature", "piece", "x", "n"])

    return run


def exact_edges(rows: DataFrame, d: int, bins: int = BINS, pieces: int = PIECES) -> list[list[float]]:
    """As ``bin_edges``, but at exact ranks, as SQL's quantile_disc.

    Approximate edges cut the values of a feature into pieces. How many values the pieces have tells which of them hold the
    ranks; these alone are ordered, each by itself.
    """
    near = bin_edges(rows, d, pieces)
    with Scratch():
        found = rows.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(_counted(d, near), "feature int, piece int, x double, n bigint")
        found = store(found.groupBy("feature", "piece", "x").agg(F.sum("n").alias("n")), "values").df
        sizes: dict[int, list[tuple[int, int]]] = {}
        for r in found.groupBy("feature", "piece").agg(F.sum("n").alias("n")).orderBy("feature", "piece").collect():  # d * pieces at most
            sizes.setdefault(r["feature"], []).append((r["piece"], r["n"]))
        wanted = []
        for j, own in sizes.items():
            total, before, at = sum(n for _, n in own), 0, 0
            for rank in (-(-k * total // bins) for k in range(1, bins)):
                while rank > before + own[at][1]:
                    before, at = before + own[at][1], at + 1
                wanted.append((j, own[at][0], rank - before))
        asked = F.broadcast(rows.sparkSession.createDataFrame(wanted, "feature int, piece int, rank bigint"))
        some = found.join(asked.select("feature", "piece").distinct(), ["feature", "piece"], "left_semi")
        some = some.withColumn("upto", F.sum("n").over(Window.partitionBy("feature", "piece").orderBy("x")))
        out: list[list[float]] = [[] for _ in range(d)]
        for r in some.join(asked, ["feature", "piece"]).filter("rank > upto - n AND rank <= upto").select("feature", "x").distinct().collect():
            out[r["feature"]].append(r["x"])
    return [sorted(x) for x in out]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value (rows x features): how many edges are below it."""
    out = np.zeros((len(values), len(edges)), np.uint8)
    for j, own in enumerate(edges):
        out[:, j] = np.searchsorted(np.array(own), values[:, j], side="left")
    return out


@dataclass
class Tree:
    """Nodes by number, the root first. Rows whose bin is ``cut`` at most go left. An inner node has a feature of 0 at least."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
        return at, at + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[node] >= 0).any():
            low = bins[rows, np.maximum(feature[node], 0)] <= cut[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)
        return node


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the weighted softmax loss by each score."""
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g * weight[:, None], p * (1 - p) * weight[:, None]


_HISTOGRAM = "tree int, node int, feature int, sums binary"  # bins that have rows (a byte each), then their gradients, hessians and counts (8 bytes each)


def _read(batch, d: int, k: int, due: list[list[Tree]]):
    """y, weight, bins and scores of a batch of packed rows; the trees of rounds that are ``due`` are added to the scores."""
    flat = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
    bins, scores = flat("bins", np.uint8).reshape(-1, d), flat("scores", "<f8").reshape(-1, k).copy()
    for trees in due:
        for c, tree in enumerate(trees):
            scores[:, c] += np.array(tree.value)[tree.leaf_of(bins)]
    return np.asarray(batch.column("y"), dtype=np.int64), np.asarray(batch.column("weight"), dtype=float), bins, scores


def _histograms(trees: list[Tree], asked: list[list[int]], d: int, due: list[list[Tree]]):
    """Sums over a partition's rows by tree, node, feature and bin, for the nodes ``asked`` of each tree."""
    k = len(trees)

    def run(batches):
        sums = [np.zeros((3, len(nodes) * d * 256)) for nodes in asked]
        for batch in batches:
            y, weight, bins, scores = _read(batch, d, k, due)
            g, h = gradients(scores, y, weight)
            for c, nodes in enumerate(asked):
                if not nodes:
                    continue
                slot = np.full(len(trees[c].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[trees[c].leaf_of(bins)]
                own = np.flatnonzero(at >= 0)
                place = ((at[own, None] * d + np.arange(d)) * 256 + bins[own]).ravel()
                for s, values in zip(sums[c], (g[own, c], h[own, c], np.ones(len(own))), strict=True):
                    s += np.bincount(place, np.repeat(values, d), minlength=len(s))
        names = [x.split(" ")[0] for x in _HISTOGRAM.split(", ")]
        for c, nodes in enumerate(asked):
            own = sums[c].reshape(3, -1, 256)
            for lo in range(0, own.shape[1], 4096):
                at = lo + np.flatnonzero(own[2, lo : lo + 4096].any(1))
                packed = []
                for j in at:
                    some = np.flatnonzero(own[2, j])
                    packed.append(some.astype(np.uint8).tobytes() + own[:, j, some].astype("<f8").tobytes())
                columns = (np.full(len(at), c), np.array(nodes, np.int64)[at // d], at % d)
                yield pa.record_batch([*(pa.array(x.astype(np.int32)) for x in columns), pa.array(packed, pa.binary())], names)

    return run


_SPLIT = "tree int, node int, feature int, cut int, gain double, l_g double, l_h double, l_n double, r_g double, r_h double, r_n double, g double, h double"
_SPLIT_TYPES = [*[pa.int32()] * 4, *[pa.float64()] * 9]


def best_cut(sums: np.ndarray, least_rows: int, least_hessian: float) -> dict:
    """The best split of (3, features, bins) sums: feature, cut, gain, and the sums of both sides and of all.

    Of equal gains (to nine digits) the smallest feature and cut are taken; gain is None where no split is allowed.
    """
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    ok = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= least_hessian) & (right[1] >= least_hessian)
    out = dict.fromkeys(("feature", "cut", "gain", "l_g", "l_h", "l_n", "r_g", "r_h", "r_n")) | {"g": float(whole[0, 0, 0]), "h": float(whole[1, 0, 0])}
    at = np.flatnonzero(ok)
    if len(at):
        lg, lh, rg, rh = (x.reshape(-1)[at] for x in (left[0], left[1], right[0], right[1]))
        f, _ = np.divmod(at, sums.shape[2])
        gain = lg**2 / lh + rg**2 / rh - (whole[0, f, 0] ** 2 / whole[1, f, 0])
        k = int(np.argmax(np.round(gain, 9)))
        feature, cut = divmod(int(at[k]), sums.shape[2])
        out |= {"feature": feature, "cut": cut, "gain": float(gain[k])}
        out |= {f"{side}_{name}": float(part[row, feature, cut]) for side, part in (("l", left), ("r", right)) for row, name in enumerate("ghn")}
    return out


def _merged(least_rows: int, least_hessian: float):
    """Sums of all partitions in order of tree, node and feature, to the best cut of each."""

    def run(batches):
        names = [x.split(" ")[0] for x in _SPLIT.split(", ")]
        key, sums, out = None, None, []

        def flush():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), _SPLIT_TYPES, strict=True)], names)

        def done():
            found = best_cut(sums[:, None], least_rows, least_hessian)
            out.append((*key, *(found[c] for c in names[3:])))

        for batch in batches:
            packed = batch.column("sums")
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "feature")), strict=True)):
                if own != key:
                    if key:
                        done()
                    key, sums = own, np.zeros((3, 256))
                data = packed[k].as_py()
                n = len(data) // 25
                sums[:, np.frombuffer(data, np.uint8, n)] += np.frombuffer(data, "<f8", 3 * n, n).reshape(3, n)
            if len(out) >= 4096:
                yield flush()
                out = []
        if key:
            done()
        yield flush()

    return run


def best_splits(histogram: DataFrame, least_rows: int = LEAST_ROWS, least_hessian: float = LEAST_HESSIAN) -> DataFrame:
    """tree, node, gain, feature, cut and the sums of both sides of the best split of each node, from the sums of all partitions.

    Of equal gains the smallest feature and cut are taken. gain is null where no split leaves both sides enough rows and hessian.
    """
    keys = ["tree", "node", "feature"]
    cuts = histogram.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(least_rows, least_hessian), _SPLIT)
    best = F.max_by(F.struct("gain", "feature", "cut", "l_g", "l_h", "l_n", "r_g", "r_h", "r_n", "g", "h"), F.struct(F.coalesce(F.round("gain", 9), F.lit(-1.0)), -F.col("feature")))
    return cuts.groupBy("tree", "node").agg(best.alias("s")).select("tree", "node", "s.*")


_ROWS = "tree int, node int, g binary, h binary, bins binary"


def _members(trees: list[Tree], asked: list[list[int]], d: int, due: list[list[Tree]]):
    """The rows of the nodes ``asked`` of each tree, packed: a row a node and batch."""

    def run(batches):
        for batch in batches:
            y, weight, bins, scores = _read(batch, d, len(trees), due)
            g, h = gradients(scores, y, weight)
            out = []
            for c, nodes in enumerate(asked):
                at = trees[c].leaf_of(bins) if nodes else None
                for node in nodes:
                    own = np.flatnonzero(at == node)
                    if len(own):
                        out.append((c, node, g[own, c].tobytes(), h[own, c].tobytes(), bins[own].tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], [x.split(" ")[0] for x in _ROWS.split(", ")])

    return run


def subtree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, leaves: int, least_rows: int, least_hessian: float = LEAST_HESSIAN) -> dict[str, dict]:
    """The best splits of all nodes, by path, that growth by largest gain meets in a tree of so many leaves over these rows."""
    n, d = bins.shape
    places = np.arange(d) * 256 + bins.astype(np.int64)

    def split(rows: np.ndarray) -> dict:
        at = places[rows].ravel()
        sums = np.stack([np.bincount(at, np.repeat(v, d), minlength=d * 256) for v in (g[rows], h[rows], np.ones(len(rows)))])
        return best_cut(sums.reshape(3, d, 256), least_rows, least_hessian)

    found, waiting = {}, []

    def reached(path: str, rows: np.ndarray) -> None:
        found[path] = split(rows)
        if (found[path]["gain"] or 0) > 0:
            heapq.heappush(waiting, (-found[path]["gain"], path, rows.tolist()))

    reached("", np.arange(n))
    for _ in range(leaves - 1):
        if not waiting:
            break
        _, path, rows = heapq.heappop(waiting)
        rows = np.array(rows)
        low = bins[rows, found[path]["feature"]] <= found[path]["cut"]
        reached(path + "l", rows[low])
        reached(path + "r", rows[~low])
    return found


_FOUND = "tree int, node int, path string, " + _SPLIT.removeprefix("tree int, node int, ")


def _finished(d: int, leaves: int, least_rows: int):
    """Members in order of tree and node, to the splits below each node."""

    def run(batches):
        key, held = None, []
        names = [x.split(" ")[0] for x in _FOUND.split(", ")]

        def done():
            g, h = (np.frombuffer(b"".join(r[k] for r in held), "<f8") for k in (0, 1))
            bins = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(-1, d)
            rows = [(*key, path, *(s[c] for c in names[3:])) for path, s in subtree(bins, g, h, leaves, least_rows).items()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_SPLIT_TYPES[:2], pa.string(), *_SPLIT_TYPES[2:]], strict=True)], names)

        for batch in batches:
            for tree, node, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, node) != key:
                    if held:
                        yield done()
                    key, held = (tree, node), []
                held.append(row)
        if held:
            yield done()

    return run


def _grown(known: dict[str, dict], rate: float, leaves: int) -> tuple[Tree, dict[int, str]]:
    """The tree grown from known splits (by path, a text of l and r), and its leaves whose best split must be known to go on."""
    tree, at, waiting, asked = Tree(), {"": 0}, [], {}

    def reached(path: str) -> None:
        found = known.get(path)
        if found is None:
            asked[at[path]] = path
        elif (found["gain"] or 0) > 0:
            heapq.heappush(waiting, (-found["gain"], path))

    reached("")
    if known.get("", {}).get("h"):
        tree.value[0] = -rate * known[""]["g"] / known[""]["h"]
    n = 1
    while waiting and n < leaves:
        path = heapq.heappop(waiting)[1]
        split, n = known[path], n + 1
        for side, node in zip("lr", tree.split(at[path], split["feature"], split["cut"]), strict=True):
            tree.value[node] = -rate * split[f"{side}_g"] / split[f"{side}_h"]
            at[path + side] = node
            if n < leaves:
                reached(path + side)
    return tree, asked


def _round(rows: DataFrame, n: int, k: int, d: int, rate: float, leaves: int, least_rows: int, local: int, due: list[list[Tree]]) -> list[Tree]:
    """One tree a class."""
    known: list[dict[str, dict]] = [{} for _ in range(k)]
    size = lambda c, path: known[c][path[:-1]][f"{path[-1]}_n"] if path else n
    while True:
        grown = [_grown(own, rate, leaves) for own in known]
        if not any(asked for _, asked in grown):
            return [tree for tree, _ in grown]
        trees = [tree for tree, _ in grown]
        few = [[node for node, path in asked.items() if size(c, path) * d <= local] for c, (_, asked) in enumerate(grown)]
        many = [[node for node in asked if node not in own] for own, (_, asked) in zip(few, grown, strict=True)]
        found = []
        if any(many):
            found += [r.asDict() | {"path": ""} for r in best_splits(rows.mapInArrow(_histograms(trees, many, d, due), _HISTOGRAM), least_rows).collect()]  # a row a node
        if any(few):
            members = rows.mapInArrow(_members(trees, few, d, due), _ROWS).repartition("tree", "node").sortWithinPartitions("tree", "node")
            found += [r.asDict() for r in members.mapInArrow(_finished(d, leaves, least_rows), _FOUND).collect()]  # two rows a leaf
        for r in found:
            known[r["tree"]][grown[r["tree"]][1][r["node"]] + r["path"]] = r
        for own, (_, asked) in zip(known, grown, strict=True):
            for path in asked.values():  # no row reached it
                own.setdefault(path, {"gain": None, "g": 0.0, "h": 0.0})


@dataclass
class Boosted:
    """Edges of the bins, first scores of the classes, and the trees of each round."""

    edges: list[list[float]]
    first: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        out = np.tile(np.array(self.first), (len(values), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += np.array(tree.value)[tree.leaf_of(bins)]
        return out

    def probabilities(self, features: str):
        """A column of arrays of probabilities from a column of arrays of numbers."""

        @F.arrow_udf("array<double>")
        def proba(column: pa.Array) -> pa.Array:
            values = np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)
            return pa.array(list(softmax(self.scores(values))), pa.list_(pa.float64())) if len(column) else pa.array([], pa.list_(pa.float64()))

        return proba(features)

    def to_dict(self) -> dict:
        return {"edges": self.edges, "first": self.first, "rounds": [[{k: getattr(t, k) for k in ("feature", "cut", "left", "right", "value")} for t in trees] for trees in self.rounds]}

    @staticmethod
    def of(facts: dict) -> Boosted:
        return Boosted(facts["edges"], facts["first"], [[Tree(**t) for t in trees] for trees in facts["rounds"]])


def packed_rows(rows: DataFrame, edges: list[list[float]], first: list[float]) -> DataFrame:
    """y, weight, bins and scores of rows (y, weight, features)."""

    def pack(batches):
        start = np.array(first, "<f8").tobytes()
        for batch in batches:
            if batch.num_rows:
                values = np.array(batch.column("features").to_pylist(), dtype=float)
                bins = [b.tobytes() for b in binned(values, edges)]
                yield pa.record_batch([batch.column("y"), batch.column("weight"), pa.array(bins, pa.binary()), pa.array([start] * len(bins), pa.binary())], ["y", "weight", "bins", "scores"])

    own = rows.selectExpr("cast(y AS int) AS y", "cast(weight AS double) AS weight", "features")
    return own.mapInArrow(pack, "y int, weight double, bins binary, scores binary")


def _updated(due: list[list[Tree]], d: int, k: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = _read(batch, d, k, due)[3]
                yield pa.record_batch([batch.column("y"), batch.column("weight"), batch.column("bins"), pa.array([s.astype("<f8").tobytes() for s in scores], pa.binary())], ["y", "weight", "bins", "scores"])

    return run


def first_scores(rows: DataFrame, k: int) -> list[float]:
    """Logarithms of the classes' shares of the weight; a class without rows has next to none."""
    have = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    total = sum(have.values())
    return [float(np.log(max(have.get(c, 0.0) / total, 1e-12))) if total else 0.0 for c in range(k)]


def fit_boosted(rows: DataFrame, k: int, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, least_rows: int = LEAST_ROWS, bins: int = BINS, local: int = LOCAL, every: int = WRITTEN) -> Boosted:
    """Fit on rows with y (0 to k - 1), weight and features (arrays of one length).

    local: a node of so many values (rows times features) at most is brought to one task, which finds all splits below it.
    Scores are written beside the binned rows after each ``every`` rounds, and tasks add the trees of the rounds since, so that
    no round depends on the plans before or walks all trees.
    """
    d = rows.select(F.size("features")).first()
    if d is None:
        return Boosted([], [0.0] * k)
    d = d[0]
    model = Boosted(bin_edges(rows, d, bins), first_scores(rows, k))
    with Scratch():
        now = store(packed_rows(rows, model.edges, model.first), "boosting")
        n = now.df.count()
        if n > SPREAD:
            now = store(spread(now.df), "boosting")
        written = 0
        for _ in range(rounds):
            model.rounds.append(_round(now.df, n, k, d, rate, leaves, least_rows, local, model.rounds[written:]))
            if len(model.rounds) - written == every:
                after = store(now.df.mapInArrow(_updated(model.rounds[written:], d, k), "y int, weight double, bins binary, scores binary"), "boosting")
                now.drop()
                now, written = after, len(model.rounds)
    return model


def first_splits(rows: DataFrame, k: int, bins: int = BINS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """tree (the class), feature, cut, edge and gain of the first split of each class's first tree."""
    d = rows.select(F.size("features")).first()[0]
    edges, first = exact_edges(rows, d, bins), first_scores(rows, k)
    packed = store(packed_rows(rows, edges, first), "boosting").df
    found = best_splits(packed.mapInArrow(_histograms([Tree() for _ in range(k)], [[0]] * k, d, []), _HISTOGRAM), least_rows)
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in e) + ")" for e in edges) + ")")
    return found.select("tree", "feature", "cut", table[F.col("feature")][F.col("cut")].alias("edge"), "gain")
