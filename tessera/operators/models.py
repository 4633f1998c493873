"""Classifiers on features with class weights: Spark ML's on standardised vectors, boosting and forests of this library on binned ones.

Training rows have label and features (an array). A model gives ``proba``, in the order of its classes.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.boosting import Boosted, fit_boosted
from tessera.operators.forest import Forest, fit_forest
from tessera.operators.metrics import align_probabilities, sample_weights
from tessera.sources.csvfile import uri

CLASSIFIERS = ("majority", "logreg", "rf", "hgb", "xgb")
IMBALANCE_POLICIES = ("balanced", "none")


def build_classifier(name: str, seed: int, total_weight: float):
    """A Spark ML estimator on ``scaled``, ``y`` and ``weight``; None for the class prior, boosting and forests."""
    own = {"featuresCol": "scaled", "labelCol": "y", "weightCol": "weight"}
    if name in ("majority", "hgb", "rf"):
        return None
    if name == "logreg":
        return LogisticRegression(**own, maxIter=3000, regParam=1 / (0.5 * max(total_weight, 1)), elasticNetParam=0, standardization=False, family="multinomial")
    if name == "xgb":
        try:
            from xgboost.spark import SparkXGBClassifier
        except ImportError as missing:
            raise ImportError("the classifier xgb needs the package xgboost") from missing
        return SparkXGBClassifier(features_col="scaled", label_col="y", weight_col="weight", tree_method="hist", n_estimators=400, max_depth=6, learning_rate=0.1, random_state=seed)
    raise ValueError(f"{name!r} is none of {CLASSIFIERS}")


@dataclass
class TrainedModel:
    """All that a prediction needs: the fitted stages, the classes and the recipe of the features."""

    pipeline: PipelineModel | None
    classes: list[str]
    extractor: str
    image_size: int
    classifier: str
    seed: int
    prior: list[float] = field(default_factory=list)
    info: dict = field(default_factory=dict)
    boosted: Boosted | None = None
    forest: Forest | None = None

    def probabilities(self, features: DataFrame) -> DataFrame:
        """``features`` with proba, in the order of ``classes``."""
        if own := self.boosted or self.forest:
            return features.withColumn("proba", own.probabilities("features"))
        if self.pipeline is None:
            return features.withColumn("proba", F.array(*map(F.lit, self.prior)))
        out = self.pipeline.transform(features.withColumn("vector", array_to_vector("features")))
        proba = vector_to_array("probability")
        return out.withColumn("proba", proba).select(*features.columns, "proba")

    def aligned(self, features: DataFrame, classes: list[str]) -> DataFrame:
        """row_idx, y and proba in the order of ``classes``."""
        scored = self.probabilities(features).withColumn("m_own", align_probabilities("proba", self.classes, classes))
        return scored.select("row_idx", F.col("label").alias("y"), F.col("m_own").alias("proba"))

    def save(self, path: str | Path) -> Path:
        """A folder with Spark ML's stages and a JSON file beside them; nothing is pickled."""
        path = Path(path)
        path.mkdir(parents=True, exist_ok=True)
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(uri(path / "stages"))
        facts = {k: getattr(self, k) for k in ("classes", "extractor", "image_size", "classifier", "seed", "prior", "info")}
        (path / "model.json").write_text(json.dumps({"kind": "trained model"} | facts, indent=2), encoding="utf-8")
        if self.boosted is not None:
            (path / "trees.json").write_text(json.dumps(self.boosted.to_dict()), encoding="utf-8")
        if self.forest is not None:
            self.forest.save(path / "forest.npz")
        return path

    @staticmethod
    def load(path: str | Path) -> TrainedModel:
        path = Path(path)
        if not (path / "model.json").is_file():
            raise TypeError(f"{path} is no stored model")
        facts = json.loads((path / "model.json").read_text(encoding="utf-8"))
        if facts.pop("kind", "") != "trained model":
            raise TypeError(f"{path} is no stored model")
        stages = PipelineModel.load(uri(path / "stages")) if (path / "stages").is_dir() else None
        trees = path / "trees.json"
        boosted = Boosted.of(json.loads(trees.read_text(encoding="utf-8"))) if trees.is_file() else None
        forest = Forest.load(path / "forest.npz") if (path / "forest.npz").is_file() else None
        return TrainedModel(stages, **facts, boosted=boosted, forest=forest)


def fit_classifier(name: str, features: DataFrame, seed: int, imbalance: str, extractor: str = "", image_size: int = 0) -> TrainedModel:
    """Fit on label and features. Scaling is part of the fitted stages, so it knows the training rows alone."""
    weighted = sample_weights(features, imbalance).withColumn("vector", array_to_vector("features"))
    began = time.perf_counter()
    counts = {r["label"]: r for r in weighted.groupBy("label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    total = sum(r["w"] for r in counts.values())
    estimator = build_classifier(name, seed, total)
    pipeline = boosted = forest = None
    n = sum(r["n"] for r in counts.values())
    if name in ("hgb", "rf"):
        places = F.create_map(*(F.lit(x) for k, c in enumerate(classes) for x in (c, k)))
        placed = weighted.select(places[F.col("label")].alias("y"), "weight", "features")
        if name == "hgb":
            boosted = fit_boosted(placed, len(classes))
        else:
            forest = fit_forest(placed, len(classes), seed)
    elif estimator is not None:
        # Spark divides by the deviation of a sample, n - 1; this one is of the whole population, n
        d = weighted.select(F.size("features")).first()[0]
        scaler = StandardScaler(inputCol="vector", outputCol="by_sample", withMean=True, withStd=True)
        whole = ElementwiseProduct(scalingVec=Vectors.dense([(n / max(n - 1, 1)) ** 0.5] * d), inputCol="by_sample", outputCol="scaled")
        indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
        fitted = Pipeline(stages=[indexer, scaler, whole]).fit(weighted)
        prepared = fitted.transform(weighted).persist()
        pipeline = PipelineModel([*fitted.stages[1:], estimator.fit(prepared)])
        prepared.unpersist()
    info = {"fit_seconds": round(time.perf_counter() - began, 3), "n_train": n}
    return TrainedModel(pipeline, classes, extractor, image_size, name, seed, [counts[c]["w"] / total for c in classes], info, boosted, forest)
