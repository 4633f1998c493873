"""The engine's own operators: literals, brute force, properties and the whole protocol on tiny images."""

import colorsys
import importlib.util
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.functions.bits import simhash, to_hex, to_long
from tessera.functions.labels import CANONICAL_CLASSES, UnknownClassError, canonical_label, group_of_name
from tessera.operators import metrics as M
from tessera.operators import similarity as S
from tessera.operators import splits as P
from tessera.operators.features import FeatureStore, Fusion, PixelProjection, build_extractor, handcrafted
from tessera.operators.groups import components, contracted, forest
from tessera.operators.models import TrainedModel, fit_classifier
from tessera.plans import cli, experiment, tracking
from tessera.sources import manifest as MF
from tessera.sources.images import ImageError, load_image, png
from tessera.sources.settings import ConfigError, Settings
from tessera.sources.synthetic import RECIPES, generate_dataset

ROWS = "row_idx bigint, path string, label string, source string, group_id string, phash string"


def rows_of(spark, hashes, label="x", group=None):
    return spark.createDataFrame([(k, f"p{k:04}", label, "s", group or f"g{k}", h) for k, h in enumerate(hashes)], ROWS)


@pytest.mark.parametrize("n,size", [(1, 4), (1000, 64), (1000, 1 << 20), (3001, 500)])
def test_exact_bootstrap_is_numpys_stream(spark, n, size):
    """Over one range or many, resamples dealt to tasks: the counts of drawing row by row."""
    rng = np.random.default_rng(n)
    classes = ["a", "b", "c"]
    rows = [(int(i), classes[rng.integers(3)], [float(x) for x in rng.dirichlet([1, 1, 1])]) for i in rng.permutation(n)]
    scored = spark.createDataFrame(rows, "row_idx bigint, y string, proba array<double>").repartition(5)
    got = M.exact_draws(scored, classes, 40, 7, size)
    cell = np.array([3 * classes.index(y) + int(np.argmax(p)) for _, y, p in sorted(rows)])
    stream = np.random.default_rng(7)
    assert (got == np.stack([np.bincount(cell[stream.integers(0, n, n)], minlength=9) for _ in range(40)])).all()


def test_demo_is_imbalanced_on_purpose():
    found = cli.demo_leaves(20)
    assert set(found["lab"]) == set(found["field"]) == set(RECIPES) and set(found["field"].values()) == {6}
    assert sorted(found["lab"].values()) == [20] * (len(RECIPES) - 1) + [60] and set(cli.demo_leaves(3)["field"].values()) == {4}


def test_labels(spark):
    assert len(CANONICAL_CLASSES) == 38 and canonical_label("Pepper__bell___Bacterial_spot") == "Pepper,_bell___Bacterial_spot"
    with pytest.raises(UnknownClassError):
        canonical_label("Rose")
    names = {"0A1b___RS 1.JPG": "0a1b", "leaf_12_flipLR.png": "leaf_12", "x_new30degFlipLR.png": "x", "IMG_270deg_aug3.jpeg": "img", "_flipTB.png": "_fliptb", "___x.png": "", "a.b.png": "a.b", ".hidden": ".hidden"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", group_of_name("n").alias("g")).collect()
    assert {r["n"]: r["g"] for r in got} == names


def test_hex_and_sign_bit(spark):
    values = ["ffffffffffffffff", "8000000000000000", "0000000000001e10", "7fffffffffffffff"]
    got = spark.createDataFrame([(v,) for v in values], "h string").withColumn("v", to_long("h")).withColumn("b", to_hex("v")).collect()
    assert [r["b"] for r in got] == values and got[0]["v"] == -1


@pytest.mark.parametrize("distance", [-1, 0, 3, 4, 63])
def test_pairs_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(12)]
    values += [values[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)] + [values[1]] * 5 + [values[2] ^ 0b101, 0, (1 << 64) - 1]
    hashes = [format(v, "016x") for v in values] + [""]
    got = {(r["a"], r["b"]): r["distance"] for r in S.near_duplicate_pairs(rows_of(spark, hashes), distance).collect()}
    assert got == {(a, b): d for a in range(len(values)) for b in range(a + 1, len(values)) if (d := (values[a] ^ values[b]).bit_count()) <= distance}


@pytest.mark.parametrize("distance,blocks", [(0, 1), (3, 4), (3, 5), (3, 6), (3, 7), (4, 8), (1, 64), (62, 63)])
def test_index_of_any_number_of_blocks_finds_each_pair_once(spark, distance, blocks):
    rng = random.Random(blocks)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({s ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(8)} | {0, 1, (1 << 64) - 1, 1 << 63})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "hash bigint")
    got = [(r["l_hash"] % (1 << 64), r["r_hash"] % (1 << 64), r["distance"]) for r in S.near_hashes(frame, frame, distance, blocks).collect() if r["l_hash"] != r["r_hash"]]
    assert sorted(got) == sorted((a, b, d) for a in values for b in values if a != b and (d := (a ^ b).bit_count()) <= distance)


def test_more_hashes_get_longer_keys(spark):
    """The work a hash does not follow the number of hashes, as it does with bands of a fixed width."""
    assert S.index_keys(1, 2) == [((1 << 32) - 1, []), (-(1 << 32), [(1 << 32) - 1])]
    found = []
    for n in (100, 40_000, 400_000):
        values = spark.range(n).selectExpr("xxhash64(id) & 281474976710655L AS hash")  # 48 bits that vary
        b = S.blocks_for(values, 3)
        keys = S._keys(3, b)
        met = values.select(F.explode(keys).alias("k")).groupBy("k").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
        found.append((b, met / n))
    assert found[0][0] < found[-1][0] and all(met < 60 for _, met in found), found


@pytest.mark.parametrize("sizes,fractions", [("one", (0.7, 0.15, 0.15)), ("mixed", (0.7, 0.15, 0.15)), ("heavy", (0.4, 0.35, 0.25)), ("mixed", (1.0, 0.0, 0.0)), ("mixed", (0.0, 0.5, 0.5))])
def test_parallel_fold(spark, sizes, fractions):
    """One label with all groups, in many chunks: equal to the fold of one group after another, in few rounds."""
    import hashlib

    rng = random.Random(4)
    size = {"one": lambda: 1, "mixed": lambda: rng.choice([1, 1, 1, 2, 3, 9]), "heavy": lambda: rng.choice([1, 50, 400])}[sizes]
    groups = [{"group_id": f"g{k}", "label": "all", "images": size()} for k in range(3000)] + [{"group_id": "n", "label": None, "images": 2}, {"group_id": "e", "label": "", "images": 1}]
    told = []
    frame = spark.createDataFrame(groups, "group_id string, label string, images bigint")
    got = {r["group_id"]: r["split"] for r in P.assign_groups(frame, fractions, 7, chunk=200, told=told).collect()}
    assert got == greedy(groups, lambda g: hashlib.md5(f"7:{g['group_id']}".encode()).hexdigest(), fractions)
    assert told[-1] == 0 and len(told) <= 16
    if sizes == "one":
        assert len(told) <= 3
    assert got == {r["group_id"]: r["split"] for r in P.assign_groups(frame, fractions, 7).collect()}


def test_guessed_state():
    for total, fractions in ((1000, (0.7, 0.15, 0.15)), (77, (0.2, 0.3, 0.5)), (10, (1.0, 0.0, 0.0))):
        for before in range(0, total + 1, 7):
            have = P.guessed(before, total, fractions)
            assert sum(have) == before
            exact = P.fold(np.ones(before, np.int64), total, (0, 0, 0), fractions)[1]
            assert all(abs(a - b) <= 2 for a, b in zip(have, exact, strict=True)), (before, have, exact)


def test_a_distance_that_compares_nothing(spark):
    with pytest.raises(ValueError):
        S.near_duplicate_pairs(rows_of(spark, ["00000000000000ff"]), 64)


def test_simhash_of_words(spark):
    import hashlib

    texts = ["a b a c", "  a\tb\x0bé\r\n", "", None, "x" * 5, "w " * 3000]
    got = [r["h"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(simhash("t").alias("h")).collect()]
    for text, found in zip(texts, got, strict=True):
        words = (text or "").split()
        sums = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        assert found == ("" if not words else format(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in sums) > len(words)), "016x"))


def test_components_of_a_chain_and_a_clique(spark):
    edges = [(k, k + 1) for k in range(20)] + [(a, b) for a in range(30, 38) for b in range(30, 38)] + [(50, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 30 for k in range(30, 38)}


def test_forest_of_a_partition():
    rng = random.Random(8)
    for _ in range(30):
        edges = [(rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(rng.randrange(1, 30))]
        root = {x: x for e in edges for x in e}
        for _ in root:
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        nodes, roots = forest(*(np.array([e[k] for e in edges]) for k in (0, 1)))
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {x: r for x, r in root.items() if x != r}


def test_edges_are_contracted_before_they_are_shuffled(spark):
    """A long chain takes a few rounds, since each partition's part of it is one star."""
    chain = spark.range(20_000).repartition(4).selectExpr("id AS a", "id + 1 AS b")
    told, few = [], []
    got = components(chain, last=0, told=told)
    assert got.selectExpr("count(*)", "max(root)", "count(DISTINCT node)").first() == (20_001, 0, 20_001) and len(told) <= 6
    assert components(chain, told=few).selectExpr("count(*)", "max(root)").first() == (20_001, 0) and len(few) == 1
    cliques = spark.createDataFrame([(40 * c + a, 40 * c + b) for c in range(5) for a in range(40) for b in range(40)], "a bigint, b bigint")
    assert contracted(cliques.coalesce(1)).count() == 5 * 39
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def joined_by_broadcast(query) -> set[str]:
    """Columns by which a query, once it has run, joined a broadcast table."""
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString()
    return {c for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan) for c in re.findall(r"(\w+)#", keys)}


def hashed_rows(spark, n=300):
    """Rows of which some share a hash and some a group, in a file, whose size Spark knows to be small."""
    return spark.range(n).selectExpr("id AS row_idx", "concat('p', id) AS path", "'x' AS label", "'s' AS source", f"concat('g', id % {n // 2}) AS group_id", f"lower(lpad(hex(xxhash64(id % {2 * n // 3})), 16, '0')) AS phash")


@pytest.mark.parametrize("distance,blocks", [(3, 4), (3, 7), (4, 5), (4, 8)])
def test_pairs_broadcast_nothing(spark, distance, blocks):
    """Rows and their keys go to the driver for a broadcast, where they take all of its memory."""
    rows = hashed_rows(spark)
    values = S.hashed(rows).select("hash").distinct()
    assert joined_by_broadcast(S.near_hashes(values, values, distance, blocks)) == set()
    assert joined_by_broadcast(S.near_duplicate_pairs(rows, distance)) == set()


def test_merge_keeps_the_first_rows_group(spark):
    rows = spark.createDataFrame([(0, "a", "x", "s", "g1", "00000000000000ff"), (1, "b", "x", "s", "g0", "00000000000000fe"), (2, "c", "x", "s", "g2", "ffffffff00000000"), (3, "d", "x", "s", "g0", "")], ROWS)
    got = {r["row_idx"]: r["group_id"] for r in S.merge_groups(rows, 3).collect()}
    assert got == {0: "g1", 1: "g1", 2: "g2", 3: "g1"}
    assert {r["group_id"] for r in S.merge_groups(rows, -1).collect()} == {"g0", "g1", "g2"}


def test_merge_broadcasts_nothing(spark):
    rows = hashed_rows(spark)
    assert joined_by_broadcast(S.group_edges(rows, 3)) == set()
    assert joined_by_broadcast(S.merge_groups(rows, 3)) == set()


def split_rows(spark, n=90, seed=3):
    rng = random.Random(seed)
    out = []
    for g in range(n // 3):
        out += [(3 * g + k, f"p{3 * g + k:04}", rng.choice("ab") if g % 9 == 0 else "abc"[g % 3], "s", f"g{g}", format(rng.getrandbits(64), "016x")) for k in range(3)]
    return spark.createDataFrame(out, ROWS)


def greedy(groups, order, fractions):
    out = {}
    for label in {g["label"] for g in groups}:
        own = sorted((g for g in groups if g["label"] == label), key=order)
        total, have = sum(g["images"] for g in own), [0, 0, 0]
        for g in own:
            lack = [f * total - h for f, h in zip(fractions, have, strict=True)]
            k = lack.index(max(lack))
            out[g["group_id"]] = P.SPLITS[k]
            have[k] += g["images"]
    return out


@pytest.mark.parametrize("fractions", [(0.7, 0.15, 0.15), (1.0, 0.0, 0.0), (0.5, 0.5, 0.0)])
def test_group_split(spark, fractions):
    import hashlib

    rows = split_rows(spark)
    result = P.group_split(rows, fractions, seed=7)
    groups = [r.asDict() for r in P.group_labels(rows).collect()]
    expected = greedy(groups, lambda g: hashlib.md5(f"7:{g['group_id']}".encode()).hexdigest(), fractions)
    got = {r["group_id"]: r["split"] for r in result.rows.collect()}
    assert got == expected and all(f > 0 or s not in got.values() for s, f in zip(P.SPLITS, fractions, strict=True))
    assert P.check_leakage(result.rows, 0) == {"shared_groups": 0, "cross_split_near_duplicates": 0}
    assert sum(result.summary()[s]["images"] for s in P.SPLITS) == 90
    exact = {r["group_id"]: r["split"] for r in P.group_split(rows, fractions, 7, exact_order=True).rows.collect()}
    assert set(exact) == set(got)


def test_leaks_are_found(spark):
    rows = split_rows(spark)
    result = P.random_image_split(rows, seed=1)
    sizes = {r["split"]: r["n"] for r in result.rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 63, "val": 14, "test": 13}
    with pytest.raises(P.LeakageError):
        P.check_leakage(result.rows, 3)
    with pytest.raises(ValueError):
        P.group_split(rows, (0.5, 0.2, 0.2))


@pytest.mark.parametrize("distance", [-1, 0, 2, 5])
def test_leak_counts_against_all_pairs(spark, distance):
    """Also where row_idx repeats across the splits, and one hash has many rows."""
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(6)]
    rows = [(k % 5, f"p{k}", "x", "s", f"g{k}", format(values[k % 6] ^ (1 << rng.randrange(64) if k % 3 == 0 else 0), "016x"), P.SPLITS[rng.randrange(3)]) for k in range(60)]
    rows.append((0, "none", "x", "s", "g", "", "val"))
    near = {(a[1], b[1]): d for a in rows for b in rows if a[1] < b[1] and a[5] and b[5] and a[6] != b[6] and (d := (int(a[5], 16) ^ int(b[5], 16)).bit_count()) <= distance}
    table = spark.createDataFrame(rows, ROWS + ", split string")
    assert P.leakage_counts(table, distance) == {"shared_groups": 0, "cross_split_near_duplicates": len(near)}
    assert {(r["a"], r["b"]): r["distance"] for r in P.cross_split_pairs(table, distance).collect()} == near


def test_leak_counts_broadcast_no_rows(spark):
    rows = P.random_image_split(hashed_rows(spark)).rows
    assert joined_by_broadcast(P.leakage(rows, 3)) <= {"r_head"}  # 4096 ranges at most


def test_crossing_pairs_broadcast_no_rows(spark):
    rows = P.random_image_split(hashed_rows(spark)).rows
    assert joined_by_broadcast(P.cross_split_pairs(rows, 3)) <= {"r_head"}


@pytest.mark.parametrize("chunk", [10, P.FOLDED])
def test_assigned_groups_are_not_broadcast(spark, chunk):
    rows = hashed_rows(spark)
    split = rows.join(P.assign_groups(P.group_labels(rows), (0.7, 0.15, 0.15), 1, chunk=chunk), "group_id")
    assert "group_id" not in joined_by_broadcast(split) and split.count() == 300


def test_leaks_through_files_and_attached_rows(spark, tmp_path):
    """Tables that each number their rows from 0: a leak between them is found, and none is invented."""
    one = lambda path, h, group: spark.createDataFrame([(0, path, "Potato___healthy", "s", group, h)], ROWS)
    same, other = "00000000000000ff", "ffffffff00000000"
    for name, rows in (("train", one("a", same, "g1")), ("val", one("b", same, "g2")), ("test", one("c", other, "g3"))):
        MF.write_manifest(rows, tmp_path / f"{name}.csv")
    split = MF.read_splits(spark, tmp_path, check_files=False)
    assert sorted(r["row_idx"] for r in split.collect()) == [0, 1, 2]
    assert P.leakage_counts(split, 0) == {"shared_groups": 0, "cross_split_near_duplicates": 1}
    with pytest.raises(P.LeakageError):
        P.check_leakage(split, 4)
    clean = P.SplitResult(one("a", same, "g1").withColumn("split", F.lit("train")).union(one("c", other, "g3").withColumn("split", F.lit("val"))), 1, (0.7, 0.15, 0.15))
    out = P.attach_augmented(clean, one("aug/a", same, "aug:g1").union(one("aug/c", other, "aug:g3")), 4)
    assert {r["path"] for r in out.rows.collect()} == {"a", "c", "aug/a"} and out.dropped_augmented == 1
    assert P.check_leakage(out.rows, 4) == {"shared_groups": 0, "cross_split_near_duplicates": 0}


def test_augmented_copies(spark):
    result = P.group_split(split_rows(spark), seed=2)
    found = {r["split"]: r for r in result.rows.orderBy("row_idx").collect()}
    held, train = found["val"], found["train"]
    copies = spark.createDataFrame(
        [(1000, "c1", "a", "aug", held["group_id"], ""), (1001, "c2", "a", "aug", "new", format(int(held["phash"], 16) ^ 1, "016x")), (1002, "c3", "a", "aug", train["group_id"], train["phash"]), (1003, "c4", "a", "aug", f"aug:{held['group_id']}", "")], ROWS
    )
    out = P.attach_augmented(result, copies, 3)
    assert {r["path"] for r in out.rows.filter("source = 'aug'").collect()} == {"c3", "c4"} and out.dropped_augmented == 2
    assert out.rows.count() == out.rows.select("row_idx").distinct().count()
    assert P.attach_augmented(result, copies, 3, match_on="leaf_id").dropped_augmented == 3


def test_augmented_copies_are_not_broadcast(spark):
    rows = hashed_rows(spark)
    result = P.group_split(rows, seed=2)
    copies = rows.withColumn("path", F.concat(F.lit("aug/"), "path"))
    assert joined_by_broadcast(P.augmented_to_drop(result.rows, copies, 3)) == set()
    assert joined_by_broadcast(P.attach_augmented(result, copies, 3).rows) == set()


def report_by_hand(y, proba, classes):
    pred, k = proba.argmax(1), len(classes)
    f1, recall = [], []
    for c in range(k):
        hit = ((y == c) & (pred == c)).sum()
        f1.append(2 * hit / max((y == c).sum() + (pred == c).sum(), 1))
        if (y == c).any():
            recall.append(hit / (y == c).sum())
    p = np.clip(proba, 1e-12, 1)
    p = p / p.sum(1, keepdims=True)
    conf, hit, edges, ece = proba.max(1), pred == y, np.linspace(0, 1, 16), 0.0
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own = (conf > lo) & (conf <= hi) if k else conf <= hi
        if own.any():
            ece += own.mean() * abs(hit[own].mean() - conf[own].mean())
    return {"accuracy": (pred == y).mean(), "macro_f1": np.mean(f1), "balanced_accuracy": np.mean(recall), "log_loss": -np.log(p[np.arange(len(y)), y]).mean(), "ece": ece}


def test_evaluation_against_numpy(spark):
    rng = np.random.default_rng(0)
    classes, y = ["a", "b'c", "d", "never"], rng.integers(0, 3, 70)
    proba = rng.dirichlet([0.6] * 4, 70)
    proba[0] = [0.4, 0.4, 0.1, 0.1]
    scored = spark.createDataFrame([(k, classes[c], p.tolist()) for k, (c, p) in enumerate(zip(y, proba, strict=True))], "row_idx bigint, y string, proba array<double>")
    report = M.evaluate("val", scored, classes, n_boot=50, seed=3, exact_bootstrap=True)
    for k, v in report_by_hand(y, proba, classes).items():
        assert abs(report.headline()[k] - v) < 1e-9, k
    pred, stream, scores = proba.argmax(1), np.random.default_rng(3), []
    for _ in range(50):
        idx = stream.integers(0, 70, 70)
        scores.append(report_by_hand(y[idx], proba[idx], classes)["macro_f1"])
    assert np.allclose(report.macro_f1_ci, np.percentile(scores, [2.5, 97.5])) and (pred >= 0).all()
    assert M.bootstrap_interval(scored, classes, 50, exact=False)[0] <= report.macro_f1
    assert sum(map(sum, report.confusion)) == pytest.approx(3, abs=1e-3) and report.per_class["never"]["support"] == 0
    with pytest.raises(ValueError):
        M.evaluate("val", scored, ["a", "d"])
    empty = M.evaluate("val", scored.limit(0), classes, n_boot=5)
    assert set(empty.headline().values()) == {0.0} and empty.n == 0
    top = scored.filter("row_idx = 0").select(M.top_classes("proba", classes).alias("t")).first()["t"]
    assert [t["label"] for t in top[:2]] == ["b'c", "a"]
    aligned = scored.limit(1).select(M.align_probabilities("proba", classes, ["d", "new", "a"]).alias("p")).first()["p"]
    assert aligned == [0.1, 0.0, 0.4]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 20), st.integers(3, 20))
def test_pixel_kernels(seed, height, width):
    image = np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)
    hsv = px.hsv(image)
    assert np.allclose(hsv[0, 0], colorsys.rgb_to_hsv(*(image[0, 0] / 255)))
    assert len({px.canonical_hash(v) for v in px.symmetries(image)}) == 1 and len(px.canonical_hash(image)) == 16
    assert px.hsv_histogram(image).sum() == pytest.approx(1) and px.lbp_histogram(image).sum() == pytest.approx(1)
    assert np.array_equal(px.resize(image, height, width), image)
    gray = px.quantised(px.luma(image), 8)
    for down, across in px.GLCM_STEPS:
        shares, slow = px.cooccurrence(gray, down, across, 8), np.zeros((8, 8))
        for y in range(height):
            for x in range(width):
                if 0 <= y + down < height and 0 <= x + across < width:
                    slow[gray[y, x], gray[y + down, x + across]] += 1
        assert np.allclose(shares, (slow + slow.T) / (2 * slow.sum()))
    assert np.allclose(px.lbp_histogram(image), px.lbp_histogram(np.rot90(image)))


def test_flat_image():
    flat = np.full((20, 20, 3), 100, np.uint8)
    found = dict(zip(px.GLCM_PROPERTIES, px.texture_properties(px.cooccurrence(px.quantised(px.luma(flat), 32), 0, 1, 32)), strict=True))
    assert found["contrast"] == 0 and found["energy"] == pytest.approx(1) and found["correlation"] == 1
    assert px.is_grayscale(flat) and px.lbp_histogram(flat)[8] == 1
    a, b = (px.augmented(flat, px.view_rng(1, 2, 3)) for _ in range(2))
    assert np.array_equal(a, b)


def test_extractors():
    images = [np.random.default_rng(k).integers(0, 256, (32, 32, 3)).astype(np.uint8) for k in range(2)]
    assert handcrafted().extract(images).shape == (2, 558) and handcrafted().extract([]).shape == (0, 558)
    both = build_extractor("pixelproj + handcrafted", seed=4)
    assert isinstance(both, Fusion) and both.name == "pixelproj128+handcrafted" and both.extract(images).shape == (2, 686)
    assert np.array_equal(PixelProjection(seed=4).extract(images), both.extract(images)[:, :128])
    for bad in ("", "none"):
        with pytest.raises(ValueError):
            build_extractor(bad)


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lab")
    classes = list(RECIPES)[:3]
    assert generate_dataset(spark, folder, leaves_per_class=5, views_per_leaf=2, size=32, seed=1, classes=classes) == 30
    (folder / "Rose___wilt").mkdir()
    broken = folder / classes[0] / "broken.PNG"
    broken.write_bytes(b"no image")
    (folder / classes[0] / "gray é#1%.png").write_bytes(png(np.full((32, 32, 3), 9, np.uint8)))
    (folder / classes[0] / "note.txt").write_text("x")
    return folder


def test_scan_validate_and_csv(spark, lab, tmp_path):
    report = MF.scan_folder(spark, lab, "lab")
    rows = report.rows.persist()
    assert rows.count() == 31 and report.unknown_folders == ["Rose___wilt"] and len(report.corrupt) == 1 and report.grayscale == 1
    assert report.class_counts()[list(RECIPES)[0]] in (10, 11) and report.imbalance_ratio() == pytest.approx(1.1)
    first = rows.orderBy("row_idx").first()
    assert first["phash"] == px.canonical_hash(load_image(first["path"])) and first["group_id"].startswith("lab:")
    MF.validate(rows)
    path = MF.write_manifest(rows, tmp_path / "m.csv")
    again = MF.read_manifest(spark, path)
    key = lambda df: sorted(map(tuple, df.select(*MF.COLUMNS).collect()))
    assert key(again) == key(rows)
    bad = spark.createDataFrame([(0, "", "Potato___healthy", "s", "", "XY"), (1, "q", "rose", "s", "g", ""), (2, "q", "potato healthy", "s", "g", "")], ROWS)
    with pytest.raises(MF.ManifestError) as told:
        MF.validate(bad)
    assert len(told.value.problems) == 8 and "(+3 more)" in str(told.value)
    with pytest.raises(MF.ManifestError):
        MF.validate(bad.limit(0))
    odd = tmp_path / "odd.csv"
    odd.write_text("path,label\na,b\n")
    with pytest.raises(MF.ManifestError):
        MF.read_manifest(spark, odd)
    with pytest.raises(ImageError):
        load_image(tmp_path / "none.png")


def test_csv_keeps_odd_cells(spark, tmp_path):
    cells = [' a,"b" ', "c\\d", "", "é\n2"]
    rows = spark.createDataFrame([(k, f"p{k}", "Potato___healthy", c, f"g{c}", "") for k, c in enumerate(cells)], ROWS)
    again = MF.read_manifest(spark, MF.write_manifest(rows, tmp_path / "m.csv"), check_files=False)
    assert [r["source"] for r in again.orderBy("row_idx").collect()] == cells


def test_protocol(spark, lab, tmp_path, monkeypatch):
    rows = S.merge_groups(MF.scan_folder(spark, lab, "lab").rows, 3).persist()
    result = P.group_split(rows, (0.5, 0.25, 0.25), seed=3)
    MF.write_splits(result, tmp_path / "splits")
    split = MF.read_splits(spark, tmp_path / "splits").persist()
    assert json.loads((tmp_path / "splits/split_report.json").read_text())["seed"] == 3
    store, tracker = FeatureStore(tmp_path / "features", batch_size=4), tracking.build_tracker("json", tmp_path / "runs", "e")
    seen, features = [], FeatureStore.features
    monkeypatch.setattr(FeatureStore, "features", lambda self, r, x, name, *a: (seen.append(name), features(self, r, x, name, *a))[1])
    choose = experiment.leaderboard
    monkeypatch.setattr(experiment, "leaderboard", lambda *a: (seen.append("choose"), choose(*a))[1])
    config = experiment.ExperimentConfig(image_size=32, classifiers=["majority", "logreg"], extractor="handcrafted", n_boot=10, train_views=1)
    out = experiment.run_experiment(config, split, store, tracker, rows.filter("label LIKE 'Tomato%'"), tmp_path / "models")
    assert seen == ["train", "val", "choose", "test", "field"] and set(out.reports) == {"val", "test", "field"}
    assert out.reports["test"].macro_f1 >= 0 and out.selected in ("majority", "logreg") and store.misses == 4
    experiment.run_experiment(config, split, store, tracker, None)
    assert store.hits == 3
    summary = out.summary()
    assert summary["extractor"] == "handcrafted" and summary["test"]["n"] == out.reports["test"].n and set(summary["val_macro_f1_by_classifier"]) == {"majority", "logreg"}
    exported = tracker.export(spark).collect()
    assert [r["run_id"] for r in exported] == sorted(r["run_id"] for r in exported) and len(exported) == 2
    assert exported[0]["classifier"] == out.selected and float(exported[0]["val_macro_f1"]) == out.reports["val"].macro_f1
    assert tracking.build_tracker("json", tmp_path / "runs", "other").export(spark).count() == 0  # a folder for each experiment
    assert tracking.as_csv(tracker.export(spark)).splitlines()[0].startswith("run_id,name,extractor,")
    model = TrainedModel.load(out.model_path)
    paths = [r["path"] for r in rows.limit(3).collect()]
    found = experiment.predict_paths(spark, model, paths).collect()
    assert [r["path"] for r in found] == paths and all(len(r["top3"]) == min(3, len(model.classes)) for r in found)
    with pytest.raises(ImageError):
        experiment.predict_paths(spark, model, [str(lab / "none.png")])
    with pytest.raises(TypeError):
        TrainedModel.load(tmp_path)


def test_weights_and_prior(spark):
    rows = spark.createDataFrame([(k, "a" if k % 4 else "b", [float(k), 1.0]) for k in range(40)], "row_idx bigint, label string, features array<float>")
    weights = {r["label"]: r["weight"] for r in M.sample_weights(rows, "balanced").select("label", "weight").distinct().collect()}
    assert weights == {"a": pytest.approx(40 / 60), "b": pytest.approx(2.0)}
    assert fit_classifier("majority", rows, 1, "none").prior == [0.75, 0.25]
    with pytest.raises(ValueError):
        M.sample_weights(rows, "other")
    with pytest.raises(ValueError):
        fit_classifier("other", rows, 1, "none")
    model = fit_classifier("rf", rows, 1, "balanced")
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in model.probabilities(rows).collect())


def test_tracking_and_settings(tmp_path):
    report = M.EvalReport("val", 1, 1.0, 1.0, (1.0, 1.0), 1.0, float("inf"), 0.0, {}, [], [])
    with pytest.raises(tracking.TrackingError):
        tracking.Run("n", "e").add(report)
    with pytest.raises(tracking.TrackingError):
        tracking.build_tracker("paper", tmp_path, "e")
    tracker = tracking.build_tracker("json", tmp_path, "e")
    for act in (lambda: tracker.log_params({}), tracker.end_run, lambda: tracker.log_eval(report)):
        with pytest.raises(tracking.TrackingError):
            act()
    tracker.start_run("n")
    with pytest.raises(tracking.TrackingError):
        tracker.log_params({"odd": 1})
    (tmp_path / ".env").write_text('# c\nTESSERA_SEED="7"\nTESSERA_IMAGE_SIZE=64\n')
    found = Settings.from_env({"TESSERA_IMAGE_SIZE": "96"}, tmp_path / ".env")
    assert (found.seed, found.image_size, found.runs_dir.name) == (7, 96, "runs")
    for bad in ({"TESSERA_SEED": "x"}, {"TESSERA_IMAGE_SIZE": "8"}, {"TESSERA_TRACKER": "z"}):
        with pytest.raises(ConfigError):
            Settings.from_env(bad, None)
    (tmp_path / "c.toml").write_text('name = "n"\nodd = 1\n')
    with pytest.raises(ValueError):
        experiment.ExperimentConfig.from_toml(tmp_path / "c.toml")
    assert cli.main(["predict", str(tmp_path), "x.png"]) == 2
    if importlib.util.find_spec("torch") is None:
        assert cli.main(["finetune"]) == 2


DATA = "/root/testdata/sf0.001"
COMPARED = ("boosting_first_splits", "class_prior", "pixel_views", "pixel_resize", "canonical_hash", "evaluate", "group_split", "validate_rows", "merge_groups", "manifest_file")


def test_registered_sql_runs_and_agrees(spark):
    """All SQL runs over the smallest tables; a part of the queries is compared with it here, the driver compares all."""
    import os

    import duckdb

    import __spark_entry__ as entry
    from tessera.plans.catalog import ORACLE_SQL, QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"bootstrap_interval"} and set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["a", "b", "distance"]
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    plain = lambda rows: sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    for name, sql in ORACLE_SQL.items():
        found = con.execute(sql)
        columns, rows = [d[0] for d in found.description], found.fetchall()
        assert len(set(columns)) == len(columns)
        if name in COMPARED:
            assert plain(tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect()) == plain(rows), name


def test_csv_is_split_by_bytes(spark, tmp_path):
    """Cells with line breaks, quotes and blank lines around them, in many splits: what one reader reads, in its order."""
    import csv

    from tessera.sources import csvfile

    rng = random.Random(6)
    odd = ["plain", 'a "quoted" one', "two\nlines", "three\r\nmore\n\nlines", "", ",", '"', "é€", " blank ", '"\n"', "end\r"]
    path = tmp_path / "m.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(["path", "la\nbel", "x"])
        for k in range(3000):
            writer.writerow([f"p{k}", rng.choice(odd), rng.choice(odd) * rng.randrange(4)])
            if k % 50 == 0:
                out.write("\r\n")
    with open(path, newline="", encoding="utf-8") as own:
        expected = [r for r in csv.reader(own) if r]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 20_000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            names, rows = csvfile.read_numbered(spark, path)
            got = [list(r)[1:] for r in rows.orderBy("number").collect()]
            assert names == expected[0] and got == expected[1:]
            assert [r["number"] for r in rows.select("number").orderBy("number").collect()] == list(range(3000))
            if size == 20_000:
                assert spark.read.option("lineSep", "\n").text(path.as_uri()).rdd.getNumPartitions() >= 4
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_csv_is_written_in_parts_and_replaced_at_once(spark, tmp_path, monkeypatch):
    import csv
    import io

    from tessera.sources import csvfile

    rows = spark.range(500).selectExpr("499 - id AS row_idx", "concat('p', id) AS path", "if(id % 7 = 0, 'a\"b\nc', 'x, y') AS label", "cast(NULL AS string) AS source", "'g' AS group_id", "'' AS phash").repartition(6)
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(MF.COLUMNS)
    writer.writerows([r[c] for c in MF.COLUMNS] for r in rows.orderBy("row_idx").collect())
    path = MF.write_manifest(rows, tmp_path / "m.csv")
    assert path.read_bytes() == out.getvalue().encode() and [p.name for p in tmp_path.iterdir()] == ["m.csv"]
    with pytest.raises(Exception):
        MF.write_manifest(rows.withColumn("label", F.expr("raise_error('stop')")), path)
    assert path.read_bytes() == out.getvalue().encode() and [p.name for p in tmp_path.iterdir()] == ["m.csv"]
    # the way that stores other than a local disk take gives the same bytes
    parts = f"{tmp_path.as_uri()}/parts"
    rows.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select(*MF.COLUMNS).mapInArrow(csvfile._lines, "value string").write.option("lineSep", "\r\n").text(parts)
    (tmp_path / "far.csv").write_text("old")
    csvfile._joined_in_store(spark, parts, (csvfile._line(list(MF.COLUMNS)) + "\r\n").encode(), f"{tmp_path.as_uri()}/far.csv")
    assert (tmp_path / "far.csv").read_bytes() == out.getvalue().encode() and not (tmp_path / "parts").exists()
    MF.write_manifest(rows.limit(0), tmp_path / "none.csv")
    assert (tmp_path / "none.csv").read_bytes() == out.getvalue().split("\r\n")[0].encode() + b"\r\n"


def _mean_colour(path, size):
    """A stand-in for decoding: the file's first byte."""
    return np.full((size, size, 3), open(path, "rb").read(1)[0], np.uint8)


def test_one_changed_file_costs_one_image(spark, tmp_path):
    """Features are kept by image, in parts that are compacted, and a part that was not finished does not count."""
    import os

    n = 200
    for k in range(n):
        (tmp_path / f"{k:04}.png").write_bytes(bytes([k % 251]) * 3)
    rows = spark.createDataFrame([(k, f"{tmp_path}/{k:04}.png", "x", f"g{k}") for k in range(n)], "row_idx bigint, path string, label string, group_id string")
    store = FeatureStore(tmp_path / "features", loader=_mean_colour, most_parts=3)
    get = lambda r, **o: {(x["row_idx"], x["view"]): (x["group_id"], x["features"]) for x in store.features(r, handcrafted(), "train", 8, **o).collect()}
    first = get(rows)
    assert len(first) == n and (store.hits, store.misses, store.extracted) == (0, 1, n)
    assert get(rows) == first and (store.hits, store.extracted) == (1, n)
    (tmp_path / "0007.png").write_bytes(bytes([250]) * 5)
    second = get(rows)
    assert store.extracted == n + 1 and {k for k in first if first[k] != second[k]} == {(7, 0)}
    # a row more and one less, in another order: places are no part of a key without views
    moved = rows.filter("row_idx <> 3").withColumn("row_idx", F.expr("1000 - row_idx"))
    third = get(moved)
    assert store.extracted == n + 1 and third[993, 0][1] == second[7, 0][1] and len(third) == n - 1
    for k in range(4):
        (tmp_path / "0009.png").write_bytes(bytes([100 + k]) * (6 + k))
        get(rows)
    assert store.extracted == n + 5
    (folder,) = (tmp_path / "features").iterdir()
    assert len(list(folder.glob("part-*"))) <= 3
    (folder / "part-zz").mkdir()  # not finished
    assert get(rows)[9, 0] != second[9, 0] and store.extracted == n + 5
    assert len(get(rows, views=2)) == 3 * n and store.extracted == 2 * n + 5
    assert get(rows.limit(0)) == {} and not os.path.exists(folder / ".part")


def test_a_folder_is_scanned_by_many_tasks_without_a_join(spark, tmp_path):
    """Listing, reading and decoding are one scan; a folder of many files is split, other files are not looked at."""
    from tessera.sources.images import scanned

    folder = tmp_path / "Corn_(maize)___healthy"
    folder.mkdir()
    for k in range(60):
        (folder / f"leaf {k}%.{['png', 'PNG', 'Png'][k % 3]}").write_bytes(png(np.full((4, 4, 3), k, np.uint8)))
    (folder / "notes.txt").write_text("no image")
    (folder / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "Rose").mkdir()
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        found = scanned(spark, [f"file://{folder}"])
        assert found.rdd.getNumPartitions() >= 6 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
        report = MF.scan_folder(spark, tmp_path, "s")
        rows = report.rows.orderBy("row_idx").collect()
        assert [r["path"] for r in rows] == [f"{folder}/{n}" for n in sorted(p.name for p in folder.iterdir()) if n.lower().endswith("png")]
        assert report.unknown_folders == ["Rose"] and report.corrupt == [f"{folder}/broken.jpg"] and report.n_corrupt == 1 and report.grayscale == 60
        quick = MF.scan_folder(spark, tmp_path, "s", compute_hash=False, check_images=False)
        assert quick.rows.count() == 61 and quick.rows.filter("phash <> ''").count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
