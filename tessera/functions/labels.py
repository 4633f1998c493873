"""Class labels of leaf images: canonical names, their spellings, and what file names say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical classes, and keys of spellings that the compact key alone does not join.
CANONICAL_CLASSES = (
    "Apple___Apple_scab",
    "Apple___Black_rot",
    "Apple___Cedar_apple_rust",
    "Apple___healthy",
    "Blueberry___healthy",
    "Cherry_(including_sour)___Powdery_mildew",
    "Cherry_(including_sour)___healthy",
    "Corn_(maize)___Cercospora_leaf_spot Gray_leaf_spot",
    "Corn_(maize)___Common_rust_",
    "Corn_(maize)___Northern_Leaf_Blight",
    "Corn_(maize)___healthy",
    "Grape___Black_rot",
    "Grape___Esca_(Black_Measles)",
    "Grape___Leaf_blight_(Isariopsis_Leaf_Spot)",
    "Grape___healthy",
    "Orange___Haunglongbing_(Citrus_greening)",
    "Peach___Bacterial_spot",
    "Peach___healthy",
    "Pepper,_bell___Bacterial_spot",
    "Pepper,_bell___healthy",
    "Potato___Early_blight",
    "Potato___Late_blight",
    "Potato___healthy",
    "Raspberry___healthy",
    "Soybean___healthy",
    "Squash___Powdery_mildew",
    "Strawberry___Leaf_scorch",
    "Strawberry___healthy",
    "Tomato___Bacterial_spot",
    "Tomato___Early_blight",
    "Tomato___Late_blight",
    "Tomato___Leaf_Mold",
    "Tomato___Septoria_leaf_spot",
    "Tomato___Spider_mites Two-spotted_spider_mite",
    "Tomato___Target_Spot",
    "Tomato___Tomato_Yellow_Leaf_Curl_Virus",
    "Tomato___Tomato_mosaic_virus",
    "Tomato___healthy",
)
EXTRA_ALIASES = {
    "tomatospidermites": "Tomato___Spider_mites Two-spotted_spider_mite",
    "tomatoyellowleafcurlvirus": "Tomato___Tomato_Yellow_Leaf_Curl_Virus",
    "tomatomosaicvirus": "Tomato___Tomato_mosaic_virus",
    "pepperbacterialspot": "Pepper,_bell___Bacterial_spot",
    "pepperhealthy": "Pepper,_bell___healthy",
}
# Fixed value: endings that offline augmentation adds to a file's stem.
AUGMENTED_ENDING = r"(?i)(?:_(?:new\d+deg(?:flip(?:lr|tb))?|\d+deg|rot\d+|aug\d+|flip(?:lr|tb)))+$"


class UnknownClassError(KeyError):
    """A name that is no spelling of a canonical class."""


def spellings() -> dict[str, str]:
    """Compact key to canonical class."""
    return {re.sub("[^a-z0-9]", "", name.lower()): name for name in CANONICAL_CLASSES} | EXTRA_ALIASES


def label_table(spark) -> DataFrame:
    """key and canonical: one row for each of the fixed spellings, small enough to broadcast."""
    return spark.createDataFrame(sorted(spellings().items()), "key string, canonical string")


def compact_key(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def with_canonical(rows: DataFrame, name: str, out: str = "label") -> DataFrame:
    """``rows`` with the canonical class of ``name``; null where the name is unknown."""
    known = label_table(rows.sparkSession).withColumnsRenamed({"key": "l_key", "canonical": out})
    return rows.withColumn("l_own", compact_key(F.col(name))).join(F.broadcast(known), F.col("l_own") == F.col("l_key"), "left").drop("l_own", "l_key")


def canonical_label(name: str) -> str:
    """The canonical class of one name. Raises UnknownClassError."""
    key = re.sub("[^a-z0-9]", "", name.lower())
    try:
        return spellings()[key]
    except KeyError:
        raise UnknownClassError(f"{name!r} (compact key {key!r}) is no known class; EXTRA_ALIASES may name it") from None


def crop_of(label: Column | str) -> Column:
    return F.substring_index(label, "___", 1)


def is_healthy(label: Column | str) -> Column:
    return (F.col(label) if isinstance(label, str) else label).endswith("___healthy")


def stem_of(file_name: Column) -> Column:
    """A file name without its last suffix; a leading dot or a dot at the end is none."""
    base = F.substring_index(file_name, "/", -1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")


def group_of_name(file_name: Column | str) -> Column:
    """The leaf that a file shows: what stands before ``___``, or else the stem without augmentation endings; in lower case."""
    stem = stem_of(F.col(file_name) if isinstance(file_name, str) else file_name)
    bare = F.lower(F.regexp_replace(stem, AUGMENTED_ENDING, ""))
    return F.when(stem.contains("___"), F.lower(F.substring_index(stem, "___", 1))).when(bare == "", F.lower(stem)).otherwise(bare)
