"""Evaluation of class probabilities as queries.

Scored rows have ``y`` (the true label), ``proba`` (an array in the order of ``classes``) and, for the bootstrap's exact
stream, ``row_idx``. Everything but log loss and calibration comes from the k x k counts of true and predicted labels.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.manifest import numbered
from tessera.sources.shared import store

LEAST = 1e-12


@dataclass
class EvalReport:
    split: str
    n: int
    accuracy: float
    macro_f1: float
    macro_f1_ci: tuple[float, float]
    balanced_accuracy: float
    log_loss: float
    ece: float
    per_class: dict[str, dict[str, float]]
    confusion: list[list[float]]
    classes: list[str]

    def headline(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in ("accuracy", "macro_f1", "balanced_accuracy", "log_loss", "ece")}

    def to_dict(self) -> dict:
        return asdict(self)


def _names(classes) -> str:
    return "array(" + ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in classes) + ")"


def with_places(scored: DataFrame, classes: list[str]) -> DataFrame:
    """``scored`` with y_idx (place of the true label, -1 if unknown), pred (the first largest probability) and conf."""
    return scored.selectExpr("*", f"cast(array_position({_names(classes)}, y) AS int) - 1 AS y_idx", "cast(array_position(proba, array_max(proba)) AS int) - 1 AS pred", "array_max(proba) AS conf")


def grid(spark, k: int) -> DataFrame:
    return spark.range(k * k).selectExpr(f"cast(id div {k} AS int) AS y_idx", f"cast(id % {k} AS int) AS pred")


def confusion_counts(scored: DataFrame, classes: list[str]) -> DataFrame:
    """y_idx, pred and n for all pairs of classes."""
    counts = with_places(scored, classes).groupBy("y_idx", "pred").agg(F.count("*").alias("n"))
    return grid(scored.sparkSession, len(classes)).join(counts, ["y_idx", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion(counts: DataFrame) -> DataFrame:
    """y_idx, pred and share of the row, to four digits; rows without images are 0."""
    totals = counts.groupBy("y_idx").agg(F.sum("n").alias("total"))
    return counts.join(totals, "y_idx").selectExpr("y_idx", "pred", "if(total > 0, round(n / total, 4), 0D) AS share")


def per_class(counts: DataFrame) -> DataFrame:
    """c, precision, recall, f1 (0 where undefined) and support of every class."""
    true = counts.groupBy(F.col("y_idx").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.expr("if(y_idx = pred, n, 0)")).alias("hit"))
    predicted = counts.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: f"if({b} > 0, {a} / ({b}), 0D)"
    return true.join(predicted, "c").selectExpr("c", f"{ratio('hit', 'predicted')} AS precision", f"{ratio('hit', 'support')} AS recall", f"{ratio('2 * hit', 'support + predicted')} AS f1", "support")


def accuracy(counts: DataFrame) -> DataFrame:
    return counts.selectExpr("coalesce(sum(if(y_idx = pred, n, 0)) / nullif(sum(n), 0), 0D) AS accuracy")


def macro_f1(classes_table: DataFrame) -> DataFrame:
    return classes_table.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def balanced_accuracy(classes_table: DataFrame) -> DataFrame:
    """Mean recall of the classes that occur."""
    return classes_table.selectExpr("coalesce(avg(recall) FILTER (WHERE support > 0), 0D) AS balanced_accuracy")


def log_loss(scored: DataFrame, classes: list[str]) -> DataFrame:
    clipped = f"transform(proba, p -> greatest({LEAST}, least(1D, p)))"
    own = with_places(scored, classes).selectExpr(f"{clipped} AS p", "y_idx").selectExpr("-ln(p[y_idx] / aggregate(p, 0D, (s, x) -> s + x)) AS loss")
    return own.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("log_loss"))


def _bin_of(conf: str, bins: int) -> str:
    """The bin of a confidence: how many upper edges are below it."""
    upper = "array(" + ", ".join(f"{float(e)!r}D" for e in np.linspace(0.0, 1.0, bins + 1)[1:]) + ")"
    return f"size(filter({upper}, e -> e < {conf}))"


def calibration_error(scored: DataFrame, classes: list[str], bins: int = 15) -> DataFrame:
    """Gap between confidence and accuracy over bins of equal width, weighted by rows; bins exclude their lower edge, but for 0."""
    own = with_places(scored, classes).selectExpr("conf", "if(pred = y_idx, 1D, 0D) AS hit", f"{_bin_of('conf', bins)} AS bin")
    binned = own.filter(f"conf >= 0 AND bin < {bins}").groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("mean"))
    return binned.crossJoin(F.broadcast(own.agg(F.count("*").alias("total")))).agg(F.coalesce(F.sum(F.expr("n / total * abs(acc - mean)")), F.lit(0.0)).alias("ece"))


def _macro_f1_of(counts: np.ndarray) -> np.ndarray:
    """Of count matrices (..., k, k)."""
    hit = np.einsum("...ii->...i", counts).astype(float)
    both = counts.sum(-1) + counts.sum(-2)
    return np.divide(2 * hit, both, out=np.zeros_like(hit), where=both > 0).mean(-1)


def _percentiles(draws: np.ndarray, k: int) -> tuple[float, float]:
    lo, hi = np.percentile(_macro_f1_of(draws.reshape(-1, k, k)), [2.5, 97.5])
    return (float(lo), float(hi))


def _interval_of_counts(counts: np.ndarray, n_boot: int, seed: int) -> tuple[float, float]:
    """From k x k counts: resamples of the multinomial."""
    if counts.sum() == 0 or n_boot == 0:
        return (0.0, 0.0)
    return _percentiles(np.random.default_rng(seed).multinomial(counts.sum(), counts.ravel() / counts.sum(), size=n_boot), len(counts))


RANGE = 1 << 26  # rows of a packed range, two bytes each
DRAWN = 1 << 20  # indices drawn at a time
SHARES = 32  # parts into which the resamples are dealt


def stream_states(n: int, n_boot: int, seed: int) -> list[dict]:
    """The states of NumPy's generator before each resample of n indices. It draws again what falls in no index, so they follow one another."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n_boot):
        out.append(rng.bit_generator.state)
        for at in range(0, n, DRAWN):
            rng.integers(0, n, min(DRAWN, n - at))
    return out


def _packed_cells(batches):
    """Cells in order of part and place, to a row a part."""
    part, held = None, []
    row = lambda: pa.record_batch([pa.array([part], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["part", "cells"])
    for batch in batches:
        parts = np.asarray(batch.column("part"))
        cells = np.asarray(batch.column("cell")).astype("<u2")
        cuts = np.append(np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1)), len(parts))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and parts[lo] != part:
                yield row()
                held = []
            part = int(parts[lo])
            held.append(cells[lo:hi].tobytes())
    if held:
        yield row()


def _drawn(n: int, k: int, states: list[dict], size: int):
    """Packed ranges with a share of the resamples, to how often each resample draws each cell of the range."""

    def run(batches):
        for batch in batches:
            for part, share, packed in zip(batch.column("part").to_pylist(), batch.column("share").to_pylist(), batch.column("cells"), strict=True):
                cells, first = np.frombuffer(packed.as_buffer(), "<u2"), part * size
                for b in range(share, len(states), SHARES):
                    rng, times = np.random.default_rng(0), np.zeros(k * k, np.int64)
                    rng.bit_generator.state = states[b]
                    for at in range(0, n, DRAWN):
                        own = rng.integers(0, n, min(DRAWN, n - at)) - first
                        times += np.bincount(cells[own[(own >= 0) & (own < len(cells))]], minlength=k * k)
                    some = np.flatnonzero(times)
                    yield pa.record_batch([pa.array(np.full(len(some), b, np.int32)), pa.array(some.astype(np.int32)), pa.array(times[some])], ["b", "cell", "times"])

    return run


def exact_draws(scored: DataFrame, classes: list[str], n_boot: int, seed: int, size: int = RANGE) -> np.ndarray:
    """Counts (n_boot, k * k) of the resamples that NumPy's index stream draws from the rows in order of row_idx.

    The cells (true and predicted label) are packed in ranges of ``size`` rows, in order. A task has one range and a share of
    the resamples; it draws their indices a bounded number at a time and counts those in its range. No row is gathered: the
    driver goes through the stream once for the states between resamples, and gets n_boot times k * k counts.
    """
    k = len(classes)
    cells = numbered(with_places(scored, classes).select("row_idx", F.expr(f"cast(y_idx * {k} + pred AS int)").alias("cell")).withColumnRenamed("row_idx", "place"), "place", "cell")
    cells = store(cells.select("cell", F.col("row_idx").alias("pos")), "cells").df
    n = cells.count()
    if n == 0 or n_boot == 0:
        return np.zeros((0, k * k), np.int64)
    packed = cells.withColumn("part", F.expr(f"pos div {size}")).repartition("part").sortWithinPartitions("part", "pos").select("part", "cell").mapInArrow(_packed_cells, "part bigint, cells binary")
    dealt = store(packed, "packed").df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(min(SHARES, n_boot) - 1)))).repartition(min(SHARES, n_boot), "part", "share")
    found = dealt.mapInArrow(_drawn(n, k, stream_states(n, n_boot, seed), size), "b int, cell int, times bigint").groupBy("b", "cell").agg(F.sum("times").alias("times"))
    out = np.zeros((n_boot, k * k), np.int64)
    for r in found.collect():
        out[r["b"], r["cell"]] = r["times"]
    return out


def bootstrap_interval(scored: DataFrame, classes: list[str], n_boot: int = 200, seed: int = 0, exact: bool = False) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of macro-F1 over resamples.

    Resamples are drawn from the multinomial of the k x k counts, which has the same distribution as drawing rows and needs
    none of them. exact: NumPy's index stream over the rows in order of row_idx instead (``exact_draws``).
    """
    if exact:
        draws = exact_draws(scored, classes, n_boot, seed)
        return _percentiles(draws, len(classes)) if len(draws) else (0.0, 0.0)
    return _interval_of_counts(_matrix(confusion_counts(scored, classes).collect(), len(classes)), n_boot, seed)


def _matrix(rows, k: int) -> np.ndarray:
    out = np.zeros((k, k), np.int64)
    for r in rows:
        out[r["y_idx"], r["pred"]] += r["n"]
    return out


def evaluate(split: str, scored: DataFrame, classes: list[str], n_boot: int = 200, seed: int = 0, exact_bootstrap: bool = False) -> EvalReport:
    """All metrics of scored rows. Raises ValueError for labels outside ``classes`` and probabilities of another length."""
    k, bins = len(classes), 15
    # one pass gives all: rows, losses and confidences by true label, predicted label and bin of confidence
    own = with_places(scored, classes).selectExpr(
        "y", "y_idx", "pred", "conf", f"coalesce(size(proba), -1) <> {k} AS odd", f"{_bin_of('conf', bins)} AS bin", f"transform(proba, p -> greatest({LEAST}, least(1D, p))) AS p"
    ).withColumn("loss", F.expr("if(odd OR y_idx < 0, 0D, -ln(p[y_idx] / aggregate(p, 0D, (s, x) -> s + x)))"))
    cells = own.groupBy("y_idx", "pred", "bin").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("loss").alias("loss"), F.count_if("odd").alias("odd"), F.collect_set(F.expr("if(y_idx < 0, coalesce(y, 'null'), NULL)")).alias("unknown")).collect()
    unknown, odd, n = sorted({y for r in cells for y in r["unknown"]}), sum(r["odd"] for r in cells), sum(r["n"] for r in cells)
    if unknown:
        raise ValueError(f"labels outside the list of classes: {unknown}")
    if odd:
        raise ValueError(f"{odd} rows have not one probability for each of {k} classes")
    counts, by_bin = _matrix(cells, k), np.zeros((bins, 2))
    for r in cells:
        if r["conf"] is not None and 0 <= r["bin"] < bins:
            by_bin[r["bin"]] += (r["n"] * (r["y_idx"] == r["pred"]), r["conf"])
    hit, true, predicted = np.diag(counts).astype(float), counts.sum(1), counts.sum(0)
    part = lambda a, b: np.divide(a, b, out=np.zeros(k), where=b > 0)
    precision, recall, f1 = part(hit, predicted), part(hit, true), part(2 * hit, true + predicted)
    shares = np.divide(counts, true[:, None], out=np.zeros((k, k)), where=true[:, None] > 0)
    return EvalReport(
        split=split,
        n=n,
        accuracy=float(hit.sum() / counts.sum()) if counts.sum() else 0.0,
        macro_f1=float(f1.mean()) if k else 0.0,
        macro_f1_ci=bootstrap_interval(scored, classes, n_boot, seed, True) if exact_bootstrap else _interval_of_counts(counts, n_boot, seed),
        balanced_accuracy=float(recall[true > 0].mean()) if (true > 0).any() else 0.0,
        log_loss=sum(r["loss"] for r in cells) / n if n else 0.0,
        ece=float(np.abs(by_bin[:, 0] - by_bin[:, 1]).sum() / n) if n else 0.0,
        per_class={c: {"precision": float(precision[i]), "recall": float(recall[i]), "f1": float(f1[i]), "support": int(true[i])} for i, c in enumerate(classes)},
        confusion=shares.round(4).tolist(),
        classes=list(classes),
    )


def sample_weights(rows: DataFrame, policy: str) -> DataFrame:
    """``rows`` with weight: n / (classes * n of the class) for "balanced", 1 for "none"."""
    if policy not in ("balanced", "none"):
        raise ValueError(f"the policy must be balanced or none, not {policy!r}")
    if policy == "none":
        return rows.withColumn("weight", F.lit(1.0))
    counts = rows.groupBy("label").agg(F.count("*").alias("w_n"))
    totals = counts.agg(F.sum("w_n").alias("w_all"), F.count("*").alias("w_k"))
    weights = counts.crossJoin(F.broadcast(totals)).selectExpr("label", "w_all / (w_k * w_n) AS weight")
    return rows.join(weights, "label")


def align_probabilities(proba: str, model_classes: list[str], classes: list[str]):
    """An array of probabilities in the order of ``classes``: 0 for classes the model lacks; its further ones go."""
    place = {c: i for i, c in enumerate(model_classes)}
    return F.array(*(F.col(proba)[place[c]] if c in place else F.lit(0.0) for c in classes))


def top_classes(proba: str, classes: list[str], n: int = 3):
    """The n most probable (label, prob), to four digits; of equal probabilities the later class comes first."""
    pairs = f"transform({proba}, (p, i) -> struct(p AS p, i AS i))"
    order = "(a, b) -> CASE WHEN a.p > b.p OR a.p = b.p AND a.i > b.i THEN -1 WHEN a.p = b.p AND a.i = b.i THEN 0 ELSE 1 END"
    return F.expr(f"transform(slice(array_sort({pairs}, {order}), 1, {n}), x -> struct(element_at({_names(classes)}, x.i + 1) AS label, round(x.p, 4) AS prob))")
