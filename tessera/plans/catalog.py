"""Every query of the engine by name, with its SQL for DuckDB.

The test tables hold no images, so documents stand in for them: a document is a manifest row whose label is its language,
whose group is its source and a digest of its text, and whose fingerprint is a SimHash of its words. Embeddings give scored
rows: their first ten values, as a softmax, are the probabilities of labels 0 to 9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels as L
from tessera.functions.bits import simhash
from tessera.operators import metrics as M
from tessera.operators import similarity as S
from tessera.operators import splits as P
from tessera.plans import pictures
from tessera.sources.manifest import numbered, problems, read_manifest, write_manifest
from tessera.sources.shared import new_path, spread, store

FRACTIONS = (0.7, 0.15, 0.15)
SEED = 42
CLASSES = [str(k) for k in range(10)]
SPELLINGS = ["Pepper__bell___Bacterial_spot", "Tomato__Tomato_YellowLeaf__Curl_Virus", "tomato spider mites", "Potato___healthy", "Corn_(maize)___healthy", "Rose___wilt", ""]
FILES = ["0A1b___RS_HL 1.JPG", "leaf_12_flipLR.png", "leaf_12_new30degFlipLR.png", "IMG_7_270deg_aug3.jpeg", "_flipTB.png", "___x.png", "a.b.c.png"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows without a hash."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS row_idx", "concat('doc/', doc_id) AS path", "lang AS label", "source", "concat(source, ':', substr(md5(text), 1, 6)) AS group_id")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows with the SimHash of their words, computed once and kept as a table for the query's joins."""
    prints = spread(table(spark, sf_dir, "documents")).select("doc_id", simhash("text").alias("phash"), "text", "lang", "source")
    rows = prints.selectExpr("doc_id AS row_idx", "concat('doc/', doc_id) AS path", "lang AS label", "source", "concat(source, ':', substr(md5(text), 1, 6)) AS group_id", "phash")
    return store(rows, "manifest").df


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scored rows."""
    own = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_idx", "cast(label AS string) AS y", "transform(slice(embedding, 1, 10), x -> exp(cast(x AS double))) AS e")
    return own.selectExpr("row_idx", "y", "transform(e, x -> x / aggregate(e, 0D, (s, v) -> s + v)) AS proba")


def near_dup_pairs(spark, sf_dir):
    return S.near_duplicate_pairs(manifest(spark, sf_dir), 3)


def near_dup_pairs_d4(spark, sf_dir):
    return S.near_duplicate_pairs(manifest(spark, sf_dir), 4)


def merge_groups(spark, sf_dir):
    return S.merge_groups(manifest(spark, sf_dir), 3).select("row_idx", "group_id")


def majority_label(spark, sf_dir):
    return P.group_labels(documents(spark, sf_dir).withColumn("group_id", F.col("source"))).select("group_id", "label", "images")


def mixed_groups(spark, sf_dir):
    return P.group_labels(documents(spark, sf_dir).withColumn("group_id", F.col("source"))).filter("labels > 1").select("group_id", "labels")


def _group_split(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.join(P.assign_groups(P.group_labels(rows), FRACTIONS, SEED), "group_id")


def group_split(spark, sf_dir):
    return _group_split(spark, sf_dir).select("row_idx", "split")


def random_split(spark, sf_dir):
    return P.random_image_split(documents(spark, sf_dir), FRACTIONS, SEED).rows.select("row_idx", "split")


def split_summary(spark, sf_dir):
    found = P.split_summary(_group_split(spark, sf_dir))
    return found.select("split", "images", "groups", F.explode("classes").alias("label", "n"))


def missing_class_notes(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("group_id", F.col("label"))
    groups = P.group_labels(rows)
    return P.missing_class_notes(groups, P.assign_groups(groups, FRACTIONS, SEED), FRACTIONS)


def leakage_random(spark, sf_dir):
    return P.leakage(P.random_image_split(manifest(spark, sf_dir), FRACTIONS, SEED).rows, 3)


def leakage_group(spark, sf_dir):
    rows = S.merge_groups(manifest(spark, sf_dir), 3)
    return P.leakage(rows.join(P.assign_groups(P.group_labels(rows), FRACTIONS, SEED), "group_id"), 3)


def cross_split_pairs(spark, sf_dir):
    return P.cross_split_pairs(P.random_image_split(manifest(spark, sf_dir), FRACTIONS, SEED).rows, 3)


def attach_augmented(spark, sf_dir):
    """A changed copy of every document, under a group of its own: those near to val or test stay away."""
    rows = manifest(spark, sf_dir)
    split = rows.join(P.assign_groups(P.group_labels(rows), FRACTIONS, SEED), "group_id")
    copies = rows.selectExpr("row_idx", "concat('aug/', path) AS path", "label", "source", "concat('aug-', group_id) AS group_id", "phash")
    away = P.augmented_to_drop(split, copies, 3)
    return S.shuffled(copies, away, "path", "left_anti").select("row_idx", "path")


def class_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def imbalance_ratio(spark, sf_dir):
    return class_counts(spark, sf_dir).selectExpr("coalesce(max(n) / min(n), 0D) AS ratio")


def class_filter(spark, sf_dir):
    """Field rows whose class the training part has."""
    rows = _group_split(spark, sf_dir)
    known = rows.filter("split = 'train' AND label <> 'fr'").select("label").distinct()
    return rows.filter("split = 'test'").join(known, "label", "left_semi").select("row_idx", "label")


def balanced_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(quality AS string) AS label")
    return M.sample_weights(rows, "balanced").select("doc_id", F.round("weight", 9).alias("weight"))


def confusion(spark, sf_dir):
    return M.confusion(M.confusion_counts(scored(spark, sf_dir), CLASSES))


def accuracy(spark, sf_dir):
    return M.accuracy(M.confusion_counts(scored(spark, sf_dir), CLASSES)).select(F.round("accuracy", 9).alias("accuracy"))


def per_class_prf(spark, sf_dir):
    found = M.per_class(M.confusion_counts(scored(spark, sf_dir), CLASSES))
    return found.select("c", *(F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")), "support")


def macro_f1(spark, sf_dir):
    return M.macro_f1(M.per_class(M.confusion_counts(scored(spark, sf_dir), CLASSES))).select(F.round("macro_f1", 9).alias("macro_f1"))


def balanced_accuracy(spark, sf_dir):
    return M.balanced_accuracy(M.per_class(M.confusion_counts(scored(spark, sf_dir), CLASSES))).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


def log_loss(spark, sf_dir):
    return M.log_loss(scored(spark, sf_dir), CLASSES).select(F.round("log_loss", 6).alias("log_loss"))


def ece(spark, sf_dir):
    return M.calibration_error(scored(spark, sf_dir), CLASSES).select(F.round("ece", 6).alias("ece"))


def top3(spark, sf_dir):
    found = scored(spark, sf_dir).select("row_idx", F.posexplode(M.top_classes("proba", CLASSES)).alias("place", "t"))
    return found.select("row_idx", "place", F.col("t.label").alias("label"), F.col("t.prob").alias("prob"))


def align_proba(spark, sf_dir):
    """Probabilities of a model that knows labels 2 to 11 in the order of labels 0 to 9."""
    aligned = scored(spark, sf_dir).select("row_idx", M.align_probabilities("proba", [str(k) for k in range(2, 12)], CLASSES).alias("p"))
    return aligned.select("row_idx", F.posexplode("p").alias("c", "p")).select("row_idx", "c", F.round("p", 9).alias("p"))


def _named(spark, sf_dir, names: list[str]) -> DataFrame:
    """row_idx and name of every document: its id picks one of ``names``, and odd ids shout it."""
    known = F.array(*map(F.lit, names))
    picked = F.element_at(known, (F.col("row_idx") % len(names) + 1).cast("int"))
    return documents(spark, sf_dir).select("row_idx", F.when(F.col("row_idx") % 2 == 1, F.upper(picked)).otherwise(picked).alias("name"))


def canonical_label(spark, sf_dir):
    return L.with_canonical(_named(spark, sf_dir, SPELLINGS), "name")


def crop_and_health(spark, sf_dir):
    rows = documents(spark, sf_dir).select("row_idx", F.element_at(F.array(*map(F.lit, L.CANONICAL_CLASSES)), (F.col("row_idx") % 38 + 1).cast("int")).alias("label"))
    return rows.select("row_idx", "label", L.crop_of("label").alias("crop"), L.is_healthy("label").alias("healthy"))


def group_id_from_name(spark, sf_dir):
    return _named(spark, sf_dir, FILES).select("row_idx", "name", L.group_of_name("name").alias("group_id"))


def manifest_file(spark, sf_dir):
    """Documents written as a manifest file and read again, with odd cells."""
    path = new_path(spark, "manifest").removeprefix("file://") + ".csv"
    rows = documents(spark, sf_dir).selectExpr("row_idx", "path", "'Potato___healthy' AS label", "concat(' \"', source, '\", ', row_idx % 7, '\\\\') AS source", "group_id", "'' AS phash")
    return read_manifest(spark, write_manifest(rows, path), check_files=False)


def numbered_rows(spark, sf_dir):
    """Places of all documents in the order of their paths."""
    return numbered(documents(spark, sf_dir).drop("row_idx"), "path").select("path", "row_idx")


def shared_groups(spark, sf_dir):
    """Groups of three rows of one label that a split by rows tears apart."""
    rows = documents(spark, sf_dir).withColumn("group_id", F.expr("concat(label, ':', row_idx div 3)"))
    return P.shared_groups(P.random_image_split(rows, FRACTIONS, SEED).rows)


def evaluate(spark, sf_dir):
    """The headline of a whole report."""
    report = M.evaluate("val", scored(spark, sf_dir), CLASSES, n_boot=0)
    return spark.createDataFrame([(report.n, *(round(v, 6) for v in report.headline().values()))], "n bigint, " + ", ".join(f"{k} double" for k in report.headline()))


def bootstrap_interval(spark, sf_dir):
    """The interval of macro-F1 by NumPy's index stream over all scored rows; SQL has no such stream."""
    found = M.bootstrap_interval(scored(spark, sf_dir), CLASSES, 200, SEED, exact=True)
    return spark.createDataFrame([tuple(round(x, 9) for x in found)], "low double, high double")


def validate_rows(spark, sf_dir):
    """Problems of a manifest with planted faults: repeated paths, unknown labels, empty groups and bad hashes."""
    rows = documents(spark, sf_dir).selectExpr(
        "row_idx", "if(row_idx % 50 = 7, 'doc/1', path) AS path", "if(row_idx % 40 = 3, label, if(row_idx % 40 = 4, 'potato healthy', 'Potato___healthy')) AS label",
        "source", "if(row_idx % 30 = 2, '', group_id) AS group_id", "if(row_idx % 20 = 1, 'XYZ', '') AS phash",
    )
    return problems(rows, check_files=False).select("row_idx", "rule")


def view_explosion(spark, sf_dir):
    from tessera.operators.features import with_views

    return with_views(documents(spark, sf_dir), 2).select("row_idx", "view")


def fusion(spark, sf_dir):
    """The two halves of every embedding, fused in the other order."""
    from tessera.operators.features import fused

    own = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "slice(embedding, 33, 32) AS a", "slice(embedding, 1, 32) AS b")
    return own.select("vec_id", F.posexplode(fused("a", "b")).alias("place", "v")).select("vec_id", "place", F.col("v").cast("double").alias("v"))


def run_export(spark, sf_dir):
    """A run for each nation: its region is the seed, and only even ones have a classifier and a metric on test."""
    from tessera.plans.tracking import export_columns

    runs = table(spark, sf_dir, "nation").selectExpr(
        "concat('r', n_nationkey) AS run_id", "n_name AS name", "map_filter(map('seed', cast(n_regionkey AS string), 'classifier', if(n_nationkey % 2 = 0, 'rf', NULL)), (k, v) -> v IS NOT NULL) AS params",
        "map_filter(map('val_macro_f1', n_nationkey / 8D, 'test_ece', if(n_nationkey % 2 = 0, 0.25D, NULL)), (k, v) -> v IS NOT NULL) AS metrics",
    )
    return export_columns(runs).select("run_id", "name", "classifier", "seed", "val_macro_f1", "val_accuracy", "test_ece")


def class_prior(spark, sf_dir):
    """What the majority classifier says of every row: the classes' shares of the weight, under both policies."""
    from tessera.operators.models import fit_classifier

    rows = table(spark, sf_dir, "labels").selectExpr("cast(quality AS string) AS label", "array(1D) AS features")
    fitted = {policy: fit_classifier("majority", rows, SEED, policy) for policy in ("none", "balanced")}
    said = [m.probabilities(table(spark, sf_dir, "labels").select("doc_id")).select("doc_id", F.lit(policy).alias("policy"), F.posexplode("proba").alias("c", "p")) for policy, m in fitted.items()]
    return said[0].union(said[1]).select("doc_id", "policy", "c", F.round("p", 9).alias("p"))


def boosting_first_splits(spark, sf_dir):
    """The first split of each class's first tree, boosted on all embeddings in 16 bins."""
    from tessera.operators.boosting import first_splits

    rows = table(spark, sf_dir, "embeddings").selectExpr("label AS y", "1D AS weight", "transform(embedding, x -> cast(x AS double)) AS features")
    found = first_splits(rows, 10, bins=16, least_rows=20)
    return found.select("tree", "feature", "cut", F.round("edge", 6).alias("edge"), F.round("gain", 6).alias("gain"))


QUERIES = {
    f.__name__: f
    for f in (
        near_dup_pairs, near_dup_pairs_d4, merge_groups, majority_label, mixed_groups, group_split, random_split, split_summary, missing_class_notes, leakage_random, leakage_group, cross_split_pairs,
        attach_augmented, class_counts, imbalance_ratio, class_filter, balanced_weights, confusion, accuracy, per_class_prf, macro_f1, balanced_accuracy, log_loss, ece, top3,
        align_proba, canonical_label, crop_and_health, group_id_from_name, validate_rows, view_explosion, fusion, run_export, manifest_file, numbered_rows, shared_groups, evaluate,
        boosting_first_splits, bootstrap_interval, class_prior,
    )
} | pictures.QUERIES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _named_sql(names: list[str]) -> str:
    return f"SELECT row_idx, if(row_idx % 2 = 1, upper(n), n) AS name FROM (SELECT doc_id AS row_idx, [{', '.join(map(_quoted, names))}][(doc_id % {len(names)} + 1)::INT] AS n FROM documents)"


def _values(*columns: list[str]) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in zip(*columns, strict=True))


_DOCS = "docs AS (SELECT doc_id AS row_idx, 'doc/' || doc_id AS path, lang AS label, source, source || ':' || substr(md5(text), 1, 6) AS group_id FROM documents)"
_BITS = " + ".join(f"(CASE WHEN sum((h >> {i}) & 1) * 2 > count(h) THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))
_MANIFEST = f"""{_DOCS}, hashes AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w FROM documents)),
prints AS (SELECT doc_id, ({_BITS})::UBIGINT AS fp FROM hashes GROUP BY doc_id), manifest AS (SELECT docs.*, fp FROM docs LEFT JOIN prints ON doc_id = row_idx)"""


def _pairs(distance: int) -> str:
    return f"pairs AS (SELECT x.row_idx AS a, y.row_idx AS b, bit_count(xor(x.fp, y.fp)) AS distance FROM manifest x JOIN manifest y ON x.row_idx < y.row_idx AND bit_count(xor(x.fp, y.fp)) <= {distance})"


_MERGED = f"""{_pairs(3)}, edges AS (SELECT a, b FROM pairs UNION SELECT x.row_idx, y.row_idx FROM manifest x JOIN manifest y ON x.group_id = y.group_id AND x.row_idx < y.row_idx),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(node, root) AS (SELECT row_idx, row_idx FROM manifest UNION SELECT sym.b, root FROM reach JOIN sym ON sym.a = node AND root < sym.b),
merged AS (SELECT m.row_idx, m.path, m.label, m.source, r.group_id, m.fp FROM manifest m JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) x ON x.node = m.row_idx JOIN manifest r ON r.row_idx = x.root)"""


def _groups(rows: str, group: str = "group_id") -> str:
    return f"""counted AS (SELECT {group} AS group_id, label, count(*) AS n, min(row_idx) AS first FROM {rows} GROUP BY ALL),
groups AS (SELECT group_id, arg_max(label, n * 1000000000 - first) AS label, sum(n)::BIGINT AS images, count(*) AS labels FROM counted GROUP BY group_id)"""


_ASSIGNED = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || group_id), group_id) AS rn, sum(images) OVER (PARTITION BY label) AS total FROM groups),
steps(label, rn, group_id, k, h0, h1, h2) AS (
SELECT DISTINCT label, 0::BIGINT, '', -1, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM groups UNION ALL
SELECT label, rn, group_id, k, h0 + if(k = 0, images, 0), h1 + if(k = 1, images, 0), h2 + if(k = 2, images, 0) FROM (
SELECT o.label, o.rn, o.group_id, o.images, s.h0, s.h1, s.h2, CASE WHEN {FRACTIONS[0]} * total - h0 >= {FRACTIONS[1]} * total - h1 AND {FRACTIONS[0]} * total - h0 >= {FRACTIONS[2]} * total - h2 THEN 0 WHEN {FRACTIONS[1]} * total - h1 >= {FRACTIONS[2]} * total - h2 THEN 1 ELSE 2 END AS k
FROM steps s JOIN ordered o ON o.label = s.label AND o.rn = s.rn + 1)),
assigned AS (SELECT group_id, CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM steps WHERE k >= 0)"""
_GROUP_SPLIT = f"WITH RECURSIVE {_DOCS}, {_groups('docs')}, {_ASSIGNED}"
_RANDOM = f"dealt AS (SELECT *, CASE WHEN rn <= round_even({FRACTIONS[0]} * n, 0) THEN 'train' WHEN rn <= round_even({FRACTIONS[0]} * n, 0) + round_even({FRACTIONS[1]} * n, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || path)) AS rn, count(*) OVER () AS n FROM {{rows}}))"
_LEAK = "SELECT (SELECT count(*) FROM (SELECT group_id FROM dealt GROUP BY group_id HAVING count(DISTINCT split) > 1)) AS shared_groups, (SELECT count(*) FROM pairs JOIN dealt x ON x.row_idx = a JOIN dealt y ON y.row_idx = b WHERE x.split <> y.split) AS cross_split_near_duplicates"
_SCORED = """scored AS (SELECT row_idx, y, list_transform(e, lambda x: x / list_sum(e)) AS proba FROM (SELECT vec_id AS row_idx, label AS y, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS e FROM embeddings)),
placed AS (SELECT row_idx, y AS y_idx, list_position(proba, list_max(proba)) - 1 AS pred, list_max(proba) AS conf, proba FROM scored),
counts AS (SELECT a.i AS y_idx, b.i AS pred, (SELECT count(*) FROM placed p WHERE p.y_idx = a.i AND p.pred = b.i) AS n FROM range(10) a(i), range(10) b(i)),
prf AS (SELECT i AS c, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(support + predicted, 0), 0) AS f1, support FROM (SELECT i, (SELECT sum(n)::BIGINT FROM counts WHERE y_idx = i) AS support, (SELECT sum(n)::BIGINT FROM counts WHERE pred = i) AS predicted, (SELECT sum(n)::BIGINT FROM counts WHERE y_idx = i AND pred = i) AS hit FROM range(10) r(i)))"""
_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_STEM = "regexp_replace(name, '([^.])\\.[^.]+$', '\\1')"
_BARE = f"lower(regexp_replace({_STEM}, '{L.AUGMENTED_ENDING}', ''))"
_KNOWN = f"known AS (SELECT * FROM (VALUES {_values(*map(list, zip(*sorted(L.spellings().items()), strict=True)))}) v(k, canonical))"

ORACLE_SQL = {
    "near_dup_pairs": f"WITH {_MANIFEST}, {_pairs(3)} SELECT * FROM pairs",
    "near_dup_pairs_d4": f"WITH {_MANIFEST}, {_pairs(4)} SELECT * FROM pairs",
    "merge_groups": f"WITH RECURSIVE {_MANIFEST}, {_MERGED} SELECT row_idx, group_id FROM merged",
    "majority_label": f"WITH {_DOCS}, {_groups('docs', 'source')} SELECT group_id, label, images FROM groups",
    "mixed_groups": f"WITH {_DOCS}, {_groups('docs', 'source')} SELECT group_id, labels FROM groups WHERE labels > 1",
    "group_split": f"{_GROUP_SPLIT} SELECT row_idx, split FROM docs JOIN assigned USING (group_id)",
    "random_split": f"WITH {_DOCS}, {_RANDOM.format(rows='docs')} SELECT row_idx, split FROM dealt",
    "split_summary": f"{_GROUP_SPLIT}, placed AS (SELECT * FROM docs JOIN assigned USING (group_id)) SELECT split, images, groups, label, n FROM (SELECT split, label, count(*) AS n FROM placed GROUP BY ALL) JOIN (SELECT split, count(*) AS images, count(DISTINCT group_id) AS groups FROM placed GROUP BY ALL) USING (split)",
    "missing_class_notes": f"WITH RECURSIVE {_DOCS}, {_groups('docs', 'label')}, {_ASSIGNED} SELECT q.label, s.split, q.groups FROM (SELECT label, count(*) AS groups FROM groups GROUP BY label) q, (VALUES ('train'), ('val'), ('test')) s(split) WHERE NOT EXISTS (SELECT 1 FROM groups g JOIN assigned a USING (group_id) WHERE g.label = q.label AND a.split = s.split)",
    "leakage_random": f"WITH {_MANIFEST}, {_pairs(3)}, {_RANDOM.format(rows='manifest')} {_LEAK}",
    "leakage_group": f"WITH RECURSIVE {_MANIFEST}, {_MERGED}, {_groups('merged')}, {_ASSIGNED}, dealt AS (SELECT * FROM merged JOIN assigned USING (group_id)) {_LEAK}",
    "cross_split_pairs": f"WITH {_MANIFEST}, {_pairs(3)}, {_RANDOM.format(rows='manifest')} SELECT least(x.path, y.path) AS a, greatest(x.path, y.path) AS b, distance FROM pairs JOIN dealt x ON x.row_idx = a JOIN dealt y ON y.row_idx = b WHERE x.split <> y.split",
    "attach_augmented": f"WITH RECURSIVE {_MANIFEST}, {_groups('manifest')}, {_ASSIGNED}, held AS (SELECT * FROM manifest JOIN assigned USING (group_id) WHERE split <> 'train'), copies AS (SELECT row_idx, 'aug/' || path AS path, 'aug-' || group_id AS group_id, fp FROM manifest) SELECT row_idx, path FROM copies c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.group_id = c.group_id OR bit_count(xor(h.fp, c.fp)) <= 3)",
    "class_counts": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang",
    "imbalance_ratio": "SELECT max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "class_filter": f"{_GROUP_SPLIT}, placed AS (SELECT * FROM docs JOIN assigned USING (group_id)) SELECT row_idx, label FROM placed WHERE split = 'test' AND label IN (SELECT label FROM placed WHERE split = 'train' AND label <> 'fr')",
    "balanced_weights": "SELECT doc_id, round(count(*) OVER () / (k * count(*) OVER (PARTITION BY quality)), 9) AS weight FROM labels, (SELECT count(DISTINCT quality) AS k FROM labels)",
    "confusion": f"WITH {_SCORED} SELECT y_idx::INT AS y_idx, pred::INT AS pred, coalesce(round(n / nullif(sum(n) OVER (PARTITION BY y_idx), 0), 4), 0) AS share FROM counts",
    "accuracy": f"WITH {_SCORED} SELECT round(avg(if(y_idx = pred, 1.0, 0.0)), 9) AS accuracy FROM placed",
    "per_class_prf": f"WITH {_SCORED} SELECT c::INT AS c, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM prf",
    "macro_f1": f"WITH {_SCORED} SELECT round(avg(f1), 9) AS macro_f1 FROM prf",
    "balanced_accuracy": f"WITH {_SCORED} SELECT round(avg(recall), 9) AS balanced_accuracy FROM prf WHERE support > 0",
    "log_loss": f"WITH {_SCORED}, clipped AS (SELECT y_idx, list_transform(proba, lambda p: greatest(1e-12, least(1.0, p))) AS p FROM placed) SELECT round(avg(-ln(p[y_idx + 1] / list_sum(p))), 6) AS log_loss FROM clipped",
    "ece": f"WITH {_SCORED}, binned AS (SELECT CASE WHEN conf <= 0 THEN 0 ELSE len(list_filter(range(1, 16), lambda i: i / 15.0::DOUBLE < conf)) END AS bin, conf, if(y_idx = pred, 1.0::DOUBLE, 0.0) AS hit FROM placed) SELECT round(sum(gap), 6) AS ece FROM (SELECT count(*) / (SELECT count(*) FROM placed) * abs(avg(hit) - avg(conf)) AS gap FROM binned GROUP BY bin)",
    "top3": f"WITH {_SCORED} SELECT row_idx, (rn - 1)::INT AS place, c::VARCHAR AS label, round(p, 4) AS prob FROM (SELECT row_idx, c, p, row_number() OVER (PARTITION BY row_idx ORDER BY p DESC, c DESC) AS rn FROM (SELECT row_idx, unnest(range(10)) AS c, unnest(proba) AS p FROM scored)) WHERE rn <= 3",
    "align_proba": f"WITH {_SCORED} SELECT row_idx, c::INT AS c, round(if(c >= 2, proba[c - 1], 0.0), 9) AS p FROM scored, range(10) r(c)",
    "canonical_label": f"WITH {_KNOWN}, named AS ({_named_sql(SPELLINGS)}) SELECT row_idx, name, canonical AS label FROM named LEFT JOIN known ON k = {_KEY.format('name')}",
    "crop_and_health": f"SELECT row_idx, label, split_part(label, '___', 1) AS crop, suffix(label, '___healthy') AS healthy FROM (SELECT doc_id AS row_idx, [{', '.join(map(_quoted, L.CANONICAL_CLASSES))}][(doc_id % 38 + 1)::INT] AS label FROM documents)",
    "group_id_from_name": f"SELECT row_idx, name, CASE WHEN contains({_STEM}, '___') THEN lower(split_part({_STEM}, '___', 1)) WHEN {_BARE} = '' THEN lower({_STEM}) ELSE {_BARE} END AS group_id FROM ({_named_sql(FILES)})",
    "manifest_file": f"WITH {_DOCS} SELECT path, 'Potato___healthy' AS label, ' \"' || source || '\", ' || (row_idx % 7) || '\\' AS source, group_id, '' AS phash, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx FROM docs",
    "numbered_rows": f"WITH {_DOCS} SELECT path, row_number() OVER (ORDER BY path) - 1 AS row_idx FROM docs",
    "shared_groups": f"WITH {_DOCS}, {_RANDOM.format(rows='docs')} SELECT label || ':' || (row_idx // 3) AS group_id FROM dealt GROUP BY ALL HAVING count(DISTINCT split) > 1",
    "evaluate": f"WITH {_SCORED}, clipped AS (SELECT y_idx, list_transform(proba, lambda p: greatest(1e-12, least(1.0, p))) AS p FROM placed), binned AS (SELECT CASE WHEN conf <= 0 THEN 0 ELSE len(list_filter(range(1, 16), lambda i: i / 15.0::DOUBLE < conf)) END AS bin, conf, if(y_idx = pred, 1.0::DOUBLE, 0.0) AS hit FROM placed) SELECT (SELECT count(*) FROM placed) AS n, (SELECT round(avg(if(y_idx = pred, 1.0, 0.0)), 6) FROM placed) AS accuracy, (SELECT round(avg(f1), 6) FROM prf) AS macro_f1, (SELECT round(avg(recall), 6) FROM prf WHERE support > 0) AS balanced_accuracy, (SELECT round(avg(-ln(p[y_idx + 1] / list_sum(p))), 6) FROM clipped) AS log_loss, (SELECT round(sum(gap), 6) FROM (SELECT count(*) / (SELECT count(*) FROM placed) * abs(avg(hit) - avg(conf)) AS gap FROM binned GROUP BY bin)) AS ece",
    "class_prior": "SELECT doc_id, policy, c::INT AS c, round(if(policy = 'none', share, 1.0::DOUBLE / k), 9) AS p FROM labels, (SELECT row_number() OVER (ORDER BY quality::VARCHAR) - 1 AS c, n / sum(n) OVER () AS share, count(*) OVER () AS k FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)), (VALUES ('none'), ('balanced')) v(policy)",
    "boosting_first_splits": """WITH v AS (SELECT label AS y, (j - 1)::INT AS feature, embedding[j]::DOUBLE AS x FROM embeddings, range(1, 65) r(j)),
        e AS (SELECT feature, unnest(list_distinct(quantile_disc(x, [k / 16 FOR k IN range(1, 16)]))) AS edge FROM v GROUP BY feature),
        c AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS cut FROM e),
        s AS (SELECT v.feature, k AS tree, c.cut, c.edge, count(*) FILTER (WHERE x <= edge) AS ln, count(*) AS n, p - (y = k)::INT AS g1, p * (1 - p) AS h1, sum(p - (y = k)::INT) FILTER (WHERE x <= edge) AS lg, sum(p - (y = k)::INT) AS g
            FROM v JOIN c USING (feature), (SELECT label AS k, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label) GROUP BY ALL),
        t AS (SELECT tree, feature, cut, edge, sum(ln) AS ln, sum(n) AS n, sum(lg) AS lg, sum(g) AS g, any_value(h1) AS h FROM s GROUP BY ALL),
        u AS (SELECT *, lg * lg / (h * ln) + (g - lg) * (g - lg) / (h * (n - ln)) - g * g / (h * n) AS gain FROM t WHERE ln >= 20 AND n - ln >= 20)
        SELECT tree, feature, cut::INT AS cut, round(edge, 6) AS edge, round(gain, 6) AS gain FROM u QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(gain, 9) DESC, feature, cut) = 1""",
    "validate_rows": f"WITH {_DOCS}, {_KNOWN}, bad AS (SELECT row_idx, if(row_idx % 50 = 7, 'doc/1', path) AS path, if(row_idx % 40 = 3, label, if(row_idx % 40 = 4, 'potato healthy', 'Potato___healthy')) AS label, if(row_idx % 30 = 2, '', group_id) AS group_id, if(row_idx % 20 = 1, 'XYZ', '') AS phash FROM docs) SELECT row_idx, 'duplicate path' AS rule FROM (SELECT row_idx, row_number() OVER (PARTITION BY path ORDER BY row_idx) AS rn FROM bad) WHERE rn > 1 UNION ALL SELECT row_idx, CASE WHEN canonical IS NULL THEN 'unknown label' ELSE 'label is not canonical' END FROM bad LEFT JOIN known ON k = {_KEY.format('label')} WHERE canonical IS NULL OR canonical <> label UNION ALL SELECT row_idx, 'empty group_id' FROM bad WHERE group_id = '' UNION ALL SELECT row_idx, 'bad phash' FROM bad WHERE phash <> '' AND NOT regexp_full_match(phash, '[0-9a-f]{{16}}')",
    "view_explosion": "SELECT doc_id AS row_idx, v::INT AS view FROM documents, range(3) r(v)",
    "fusion": "SELECT vec_id, (i - 1)::INT AS place, list_concat(embedding[33:64], embedding[1:32])[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)",
    "run_export": "SELECT 'r' || n_nationkey AS run_id, n_name AS name, if(n_nationkey % 2 = 0, 'rf', '') AS classifier, n_regionkey::VARCHAR AS seed, (n_nationkey / 8.0::DOUBLE)::VARCHAR AS val_macro_f1, '' AS val_accuracy, if(n_nationkey % 2 = 0, '0.25', '') AS test_ece FROM nation",
} | pictures.ORACLE_SQL
