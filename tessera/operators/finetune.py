"""Fine-tuning of a network on images, where torch is installed: Spark decodes, torch's distributor trains, Spark predicts.

Spark writes the decoded training images into the shared folder, in as many files as there are workers at least. Each worker
of the distributor reads its own files, row group by row group, so that no process holds all images; gradients are averaged
between workers. The first one writes the weights beside the images, and prediction is a ``mapInArrow`` over decoded images.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.operators.features import TORCH_ARCHS, normalised
from tessera.operators.metrics import align_probabilities
from tessera.sources.images import loaded, pixels_of
from tessera.sources.shared import new_path

ARCHS = ("tiny", *TORCH_ARCHS)


def needs_torch(arch: str) -> None:
    """Raise ValueError for an unknown network, ImportError if what it needs is not installed."""
    if arch not in ARCHS:
        raise ValueError(f"{arch!r} is none of {', '.join(ARCHS)}")
    if missing := [m for m in ("torch", *(["torchvision"] if arch != "tiny" else [])) if find_spec(m) is None]:
        raise ImportError(f"fine-tuning {arch} needs {' and '.join(missing)}")


def network(arch: str, classes: int):
    """``tiny``, three convolutions of 16, 32 and 64 channels, or a pretrained network with a new last layer."""
    from torch import nn

    if arch == "tiny":
        widths, layers = (3, 16, 32, 64), []
        for before, after in zip(widths, widths[1:], strict=False):
            layers += [nn.Conv2d(before, after, 3, padding="same"), nn.BatchNorm2d(after), nn.ReLU(), nn.MaxPool2d(2)]
        return nn.Sequential(*layers, nn.AdaptiveAvgPool2d(1), nn.Flatten(), nn.Linear(widths[-1], classes))
    from torchvision.models import get_model

    whole = get_model(arch, weights="DEFAULT")
    place = [name for name, m in whole.named_modules() if isinstance(m, nn.Linear)][-1]
    parent, _, leaf = place.rpartition(".")
    setattr(whole.get_submodule(parent), leaf, nn.Linear(whole.get_submodule(place).in_features, classes))
    return whole


def decoded(rows: DataFrame, size: int) -> DataFrame:
    """row_idx, label and pixels (size * size * 3 bytes) of every row. Raises, in a task, for a file that is no image."""

    def shrink(batches):
        for batch in batches:
            found = [px.resize(pixels_of(i["height"], i["width"], i["nChannels"], i["data"]), size, size).tobytes() for i in batch.column("image").to_pylist()]
            yield pa.record_batch([batch.column("row_idx"), batch.column("label"), pa.array(found, pa.binary())], ["row_idx", "label", "pixels"])

    whole = loaded(rows.select("row_idx", "path", "label")).withColumn("image", F.expr("coalesce(image, raise_error(concat(path, ' is no image')))"))
    return whole.mapInArrow(shrink, "row_idx bigint, label string, pixels binary")


def _train(folder: str, weights: list[float], classes: list[str], arch: str, epochs: int, rate: float, batch: int, size: int, seed: int, device: str) -> str:
    """One worker: its files, batch by batch, through ``epochs`` passes; returns where the weights are."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    import torch
    import torch.distributed as dist

    files, root = pafs.FileSystem.from_uri(folder)
    paths = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    dist.init_process_group("nccl" if device == "cuda" else "gloo")
    rank, workers = dist.get_rank(), dist.get_world_size()
    torch.manual_seed(seed)
    model = torch.nn.parallel.DistributedDataParallel(network(arch, len(classes)).to(device))
    optimiser = torch.optim.AdamW(model.parameters(), lr=rate)
    loss = torch.nn.CrossEntropyLoss(weight=torch.tensor(weights, dtype=torch.float32, device=device))
    place, rng = {c: k for k, c in enumerate(classes)}, np.random.default_rng([seed, rank])
    for _ in range(epochs):
        with model.join():  # workers may have different numbers of batches
            for k in rng.permutation(np.arange(rank, len(paths), workers)):
                for rows in pq.ParquetFile(files.open_input_file(paths[k])).iter_batches(batch):
                    images = [px.augmented(np.frombuffer(p.as_py(), np.uint8).reshape(size, size, 3), rng) for p in rows.column("pixels")]
                    truth = torch.tensor([place[c] for c in rows.column("label").to_pylist()], device=device)
                    optimiser.zero_grad()
                    loss(model(torch.from_numpy(normalised(images)).to(device)), truth).backward()
                    optimiser.step()
    out = f"{root}/weights.pt"
    if rank == 0:
        with files.open_output_stream(out) as stream:
            torch.save({k: v.cpu() for k, v in model.module.state_dict().items()}, stream)
    dist.destroy_process_group()
    return out


@dataclass
class FineTuned:
    """A trained network: where its weights are, and how to read images for it."""

    weights: str
    classes: list[str]
    arch: str
    image_size: int
    device: str = "cpu"

    def aligned(self, rows: DataFrame, classes: list[str] | None = None, batch: int = 32) -> DataFrame:
        """row_idx, y and proba in the order of ``classes`` (of the model's own, if none are given)."""
        weights, own, arch, size, device = self.weights, self.classes, self.arch, self.image_size, self.device

        def predict(batches):
            import pyarrow.fs as pafs
            import torch

            files, path = pafs.FileSystem.from_uri(weights)
            model = network(arch, len(own)).to(device)
            with files.open_input_file(path) as stream:
                model.load_state_dict(torch.load(stream, map_location=device))
            model.eval()
            for rows_ in batches:
                for k in range(0, rows_.num_rows, batch):
                    some = rows_.slice(k, batch)
                    images = [np.frombuffer(p.as_py(), np.uint8).reshape(size, size, 3) for p in some.column("pixels")]
                    with torch.inference_mode():
                        proba = torch.softmax(model(torch.from_numpy(normalised(images)).to(device)), 1).double().cpu().tolist()
                    yield pa.record_batch([some.column("row_idx"), some.column("label"), pa.array(proba, pa.list_(pa.float64()))], ["row_idx", "y", "proba"])

        found = decoded(rows, size).mapInArrow(predict, "row_idx bigint, y string, proba array<double>")
        return found.withColumn("proba", align_probabilities("proba", own, classes or own))


def finetune(train: DataFrame, arch: str = "tiny", epochs: int = 5, rate: float = 1e-3, batch: int = 32, image_size: int = 64, seed: int = 42, device: str = "cpu", workers: int = 1) -> FineTuned:
    """Train on row_idx, path and label with class-balanced cross-entropy and augmented images."""
    needs_torch(arch)
    from pyspark.ml.torch.distributor import TorchDistributor

    spark: SparkSession = train.sparkSession
    folder = new_path(spark, "finetune")
    decoded(train, image_size).repartition(4 * workers, F.xxhash64(F.lit(seed), "row_idx")).write.parquet(folder)
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes, total = sorted(counts), sum(counts.values())
    balance = [total / (len(classes) * counts[c]) for c in classes]
    local = spark.sparkContext.master.startswith("local")
    weights = TorchDistributor(num_processes=workers, local_mode=local, use_gpu=device == "cuda").run(_train, folder, balance, classes, arch, epochs, rate, batch, image_size, seed, device)
    scheme, _, _ = folder.partition(":/")
    return FineTuned(f"{scheme}://{weights}", classes, arch, image_size, device)
