"""Operators on documents against brute force, on small tables with nulls, ties, copies and odd columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, decontaminate, jaccard, quality, substring, toxicity
from tessera.llm.wordhash import runs_inside, utf8, window_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=5, n=60):
    """Base texts, exact and near copies, shared passages, nulls, empties, short and long ones."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("tha", "onr", "él", "Ing", "re") for b in ("st", "ou", "ß", "a.", "ndé", "x")]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for k in range(n):
        own = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40, 90]))
        if k % 7 == 3:
            own[2:2] = passage.split()
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    for k in range(0, n, 4):
        near = texts[k].split()
        near[rng.randrange(len(near))] = "changed"
        texts += [texts[k], " ".join(near), texts[k].upper()]
    texts += [None, "", " \t\n", "one", "one", "One", passage + " " + passage, " ".join(rng.choices(vocabulary, k=3000))]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aA bé\n\t\x0b z", max_size=30), max_size=8), st.integers(1, 6))
def test_words_and_windows(texts, size):
    w = words(*utf8(pa.array(texts, pa.string())), lower=True)
    hashes = w.hashes()
    expected = [WORD.findall(lower(t)) for t in texts]
    assert np.diff(w.begin).tolist() == [len(x) for x in expected]
    flat = [x for own in expected for x in own]
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist(), strict=True)))
    at = runs_inside(w, size)
    runs = [tuple(own[k : k + size]) for own in expected for k in range(len(own) - size + 1)]
    got = window_hashes(hashes, size)[at].tolist()
    assert len(got) == len(runs) and len(set(got)) == len(set(runs)) == len(set(zip(runs, got, strict=True)))


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    expected = brute_components(rows)
    assert got == expected
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(frame(spark, rows)).collect())
    assert kept == sorted(i for i, (_, c) in expected.items() if i == c)


def test_jaccard_chain_of_near_copies(spark):
    """Each text is near the next one only; the whole chain is one component, and a stranger with a shared passage is none."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([f"x{k}{j}" for j in range(k * 4)] + base[k * 4 :])) for k in range(12)]
    rows.append((99, " ".join(base[:30] + [f"y{k}" for k in range(90)])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def brute_removal(rows, size=20):
    first, own = {}, {i: WORD.findall(t or "") for i, t in sorted(rows)}
    for i, w in own.items():
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (i, k))
    out = {}
    for i, w in own.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] != (i, k):
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def test_substring_against_brute_force(spark):
    rows = corpus(seed=8) + [(500 + k, " ".join(["a", "b"] * (15 + k))) for k in range(3)]
    expected = brute_removal(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.removal_digest(frame(spark, rows)).collect()}
    assert got == {i: e[:3] for i, e in expected.items()}
    cleaned = {r["doc_id"]: r["text"] for r in substring.cleaned(frame(spark, rows)).collect()}
    assert set(cleaned) == {i for i, e in expected.items() if e[3] or not e[1]}
    assert all(WORD.findall(t or "") == expected[i][3] for i, t in cleaned.items())
    assert all(cleaned[i] == t for i, t in rows if not expected[i][1])


def test_empty_tables_and_null_ids(spark):
    none = frame(spark, [])
    assert jaccard.near_duplicates(none).count() == 0 and substring.removal_digest(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y")], "doc_id bigint, text string, component_id string")
    got = sorted(map(tuple, jaccard.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3)], key=str)
    assert substring.removal_digest(odd).count() == 3


def test_one_frequent_ngram_is_met_in_parts(spark):
    """Postings of one key beyond a block are compared in parts that hold two blocks at most, and every pair is met once."""
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, k) for k in range(3)], "gram bigint, doc_id bigint")
    parts = {}
    for r in jaccard.blocked(rows, block=8).collect():
        parts.setdefault((r["gram"], r["row"], r["column"]), []).append((r["doc_id"], r["role"]))
    met = [(g, i, j) for (g, _, _), own in parts.items() for i, a in own if a & 1 for j, b in own if b & 2]
    assert len(met) == len(set(met)) and set(met) == {(g, i, j) for g, n in ((1, 50), (2, 3)) for i in range(n) for j in range(n)}
    assert len(parts) == 50 and max(map(len, parts.values())) < 40  # seven blocks a side
    # documents of common words alone, whose first n-grams are shared by all
    rng, old = random.Random(4), jaccard.BLOCK
    words_ = [f"w{k}" for k in range(6)]
    rows = [(k, " ".join(rng.choices(words_, k=rng.choice([40, 60, 90])))) for k in range(60)]
    rows += [(100 + k, " ".join([*t.split()[:-1], "end"])) for k, t in rows[:20]]
    jaccard.blocked.__defaults__ = (5,)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    finally:
        jaccard.blocked.__defaults__ = (old,)
    assert got == brute_components(rows)


def test_a_hot_ngram_and_a_very_long_text_end_to_end(spark):
    """1,300 documents share an n-gram of their prefixes, more than a part has, and a passage; one text has 120,000 words."""
    rng = random.Random(11)
    line = "all of us share this line here"
    rows = [(k, f"a{k} b{k} {line} c{k % 650} d{k % 650}" if k % 3 else f"{line} a{k % 300} b{k % 300} c{k % 300} d{k % 300} e{k % 300}") for k in range(1300)]
    long = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    long[90_000:90_040] = long[100:140]
    rows += [(5000, " ".join(long)), (5001, " ".join(long[:118_000])), (5002, " ".join(long[50_000:50_030]))]
    sets = {i: shingle_set(t) for i, t in rows}
    by_gram = {}
    for i, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(i)
    root = {i: i for i in sets}
    for i in sorted(sets):
        shared = {}
        for g in sets[i]:
            for j in by_gram[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()} if a != b else root
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets} and got[5001][1] == 5000
    passage = " ".join(f"p{k}" for k in range(25))
    docs = [(k, f"x{k} {passage} y{k}") for k in range(1300)] + rows[-3:]
    found = {r["doc_id"]: r["n_removed"] for r in substring.removal_digest(frame(spark, docs)).collect()}
    assert found[0] == 0 and all(found[k] == 25 for k in range(1, 1300))
    assert found[5000] == 40 and found[5001] == 118_000 and found[5002] == 30


def test_clashing_names_stay(spark):
    rows = corpus(3, 12)
    odd = spark.createDataFrame([(i, t, f"a{i}", f"b{i}", f"c{i}", f"d{i}") for i, t in rows], "doc_id bigint, text string, s_id string, s_first string, s_second string, j_away string")
    kept = jaccard.keep_one(odd)
    expected = {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert kept.columns == odd.columns and {(r["doc_id"], r["j_away"]) for r in kept.collect()} == {(i, f"d{i}") for i in expected}
    cleaned = substring.cleaned(odd)
    left = {i for i, e in brute_removal(rows).items() if e[3] or not e[1]}
    assert cleaned.columns == odd.columns and {(r["doc_id"], r["s_id"], r["s_first"], r["s_second"]) for r in cleaned.collect()} == {(i, f"a{i}", f"b{i}", f"c{i}") for i in left}
    assert jaccard.keep_one(odd.limit(0)).count() == substring.cleaned(odd.limit(0)).count() == 0


def encode_reference(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_matches_the_library_and_decodes(spark, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "<|endoftext|> it's  12345 é  x\n\n  y", "a" * 700, "thth" * 300, "\U0001f600\U0001f469‍\U0001f52c", "日本語 テスト", *[t for _, t in corpus(2, 20)]]
    rows = frame(spark, list(enumerate(texts))).withColumnRenamed("lang", "ids")
    found = bpe.encode(rows, path, pattern)
    for r in found.select("doc_id", "ids", "ids_sha256", bpe.decoded("ids", path).alias("bytes")).collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()


def test_bpe_folds_agree(spark, vocabulary):
    path, pattern = vocabulary
    ranks = bpe.load_ranks(path)
    rng = random.Random(4)
    for _ in range(200):
        word = bytes(rng.choices(b"thenaio \xc3\xa9\xff", k=rng.choice([1, 2, 9, 60, 150])))
        expected = [ranks[word]] if word in ranks else encode_reference(word, ranks)
        assert bpe.fold(word, ranks) == expected and (word in ranks or bpe._fold_long(word, ranks) == expected)
    docs = frame(spark, corpus(3, 12))
    native = bpe.encode_words(bpe.distinct_words(docs, pattern), path).collect()
    assert len(native) > 30 and all(r["ids"] == bpe.fold(r["word"].encode(), ranks) for r in native)


BENCHMARK = "item_id bigint, text string"


def test_decontamination(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "zeta", "eta"], k=n))
    question = "a train leaves the station with 40 passengers and travels 120 km before Anna and 7 friends of Anna get off how many are left"
    changed = question.replace("40", "55").replace("120 km", "95 miles").replace("Anna", "Bert").replace("7", "3")
    mixed = changed.replace("of Bert", "of Carl")
    items = spark.createDataFrame([(1, question), (2, "what is the capital of the country"), (3, None), (4, "yes"), (None, question)], BENCHMARK)
    texts = {
        0: filler(30) + " " + question.upper().replace("ANNA", "Anna") + ". " + filler(9),
        1: filler(20) + " " + changed + " " + filler(5),
        2: filler(20) + " " + mixed + " " + filler(5),
        3: filler(200),
        4: "so: What is the capital, of the country?! " + filler(3),
        5: None,
        6: "yes",
        7: "the train leaves and many are left",
    }
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.matches(frame(spark, texts.items()), items).collect()}
    assert got[1, 1] is False and got[4, 2] is True and (2, 1) not in got
    assert got[6, 4] is True  # a document of the item's one token
    assert set(got) <= {(0, 1), (1, 1), (4, 2), (6, 4)}
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, texts.items()), items).collect()}
    assert kept == set(texts) - {i for i, _ in got}
    assert decontaminate.matches(frame(spark, texts.items()), items.limit(0)).count() == 0
    # an index in many blocks gives the same rows
    again = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame(spark, texts.items()), items, block=7).collect()}
    assert again == set(got)


def test_decontamination_has_no_python(spark):
    plan = decontaminate.matches(frame(spark, [(1, "x")]), spark.createDataFrame([(1, "a b c d e f g h i j k")], BENCHMARK))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def labelled(seed, n):
    rng = random.Random(seed)
    good, bad, insult = ["the", "of", "and", "reason", "water", "green", "letter"], ["BUY!!", "|", "$$$", "win"], ["moron", "idiot"]
    rows, labels = [], []
    for i in range(n):
        quality_label, toxic = int(rng.random() < 0.7), int(rng.random() < 0.3)
        own = rng.choices(good if quality_label else bad, k=rng.randrange(20, 80))
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(insult))
        elif i % 3 == 0:
            own.insert(rng.randrange(len(own)), "muslim")
        if toxic and i % 2:
            own.insert(0, "muslim")
        rows.append((i, " ".join(own)))
        labels.append((i, quality_label, toxic))
    return rows, labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = labelled(9, 500)
    docs = frame(spark, rows + [(900, None), (901, ""), (902, "word " * 50_000)])
    truth = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1), (77_777, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(quality.training_rows(quality.with_statistics(docs), truth))
    scored = {r["doc_id"]: r["s"] for r in quality.with_statistics(docs).selectExpr("doc_id", f"{model.score()} AS s").collect()}
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0
    right = [(scored[i] >= 0.3) == bool(q) for i, q, _ in labels if held(i)]
    assert sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for s in scored.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in scored.values())
    toxic = toxicity.fit(docs, truth)
    scored = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxic.score()("text").alias("s")).collect()}
    right = [(scored[i] >= 0.5) == bool(t) for i, _, t in labels if held(i)]
    assert sum(right) / len(right) > 0.97 and scored[900] == scored[901]


def test_counterfactual_penalty_takes_weight_from_names(spark):
    rows, labels = [], []
    rng = random.Random(1)
    for i in range(400):  # the name goes with insults in training
        toxic = int(i % 2)
        own = rng.choices(["water", "green", "letter", "stone"], k=12) + (["moron"] if toxic and i % 4 == 1 else []) + (["muslim"] if toxic else [])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    docs, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    texts = pa.array(["the muslim wrote a letter", "the christian wrote a letter"])
    gap = {}
    for weight in (0.0, 50.0):
        a, b = toxicity.fit(docs, truth, counterfactual=weight).score_texts(texts)
        gap[weight] = abs(a - b)
    assert gap[50.0] < 0.2 * gap[0.0]


def test_names_are_of_people():
    """A capital alone is no name of somebody; titles, groups and plurals of origin are."""
    found = lambda t: {n for _, n in toxicity._people(*toxicity._terms(pa.array([t])))}
    assert found("under the Apache License and the GNU General Public terms. Red Hat sells Linux") == set()
    assert found("I met Dr. Smith and Mrs Jones there") == {"smith", "jones"}
    assert found("people from Narnia came, women of Avalon too, and Ruritanian people") == {"narnia", "avalon", "ruritanian"}
    assert found("all Syldavians and the Bordurians, the Houses") == {"syldavians", "bordurians"}
    assert found("Smith") == found("") == set()


def test_descent_reaches_the_least_loss():
    """The sum of weighted logistic loss, ridge and squared changes is as low as a plain descent over whole matrices gets it."""
    rng = np.random.default_rng(3)
    n, k = 60, 7
    x, y, times = rng.random((n, k)) < 0.4, rng.integers(0, 2, n), rng.integers(1, 4, n).astype(float)
    s = rng.integers(-1, 2, (9, k))
    swap_times = rng.integers(1, 3, 9).astype(float)
    ridge, strength = 0.01, 1.0
    weight = times * np.where(y == 1, 0.5 / times[y == 1].sum(), 0.5 / times[y == 0].sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w**2).sum() + strength * (swap_times / swap_times.sum() * (s @ w) ** 2).sum()

    w, b = np.zeros(k), 0.0
    for _ in range(20_000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.2 * (x.T @ g + ridge * w + 2 * strength * s.T @ (swap_times / swap_times.sum() * (s @ w))), b - 0.2 * g.sum()
    texts = [np.flatnonzero(row).astype("<i4") for row in x]
    swaps = [np.concatenate((np.flatnonzero(row > 0) + 1, -(np.flatnonzero(row < 0) + 1))).astype("<i4") for row in s]
    got_w, got_b = toxicity._descend(k, texts, y, times, swaps, swap_times, ridge, strength, 600)
    assert loss(got_w, got_b) <= loss(w, b) + 1e-4 and np.abs(got_w - w).max() < 0.1


def test_counterfactual_penalty_on_names_of_the_data(spark):
    """Names that no list has are found inside sentences; the penalty keeps scores of neutral sentences from moving with them."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):  # Zorbians go with insults in training, Quellians without
        toxic = int(i % 2)
        who = rng.choice(["Zorbians", "Zorbians", "Zorbians", "Quellians"] if toxic else ["Quellians", "Quellians", "Quellians", "Zorbians"])
        own = [rng.choice(["water", "green", "letter", "stone"]) for _ in range(8)] + ([rng.choice(["moron", "idiot"])] if toxic and i % 4 == 1 else [])
        rows.append((i, f"Nothing here. The {who} {' '.join(own)}!"))
        labels.append((i, 1, toxic))
    docs, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    neutral = pa.array([f"The {who} wrote a letter to the {other}." for who in ("Zorbians", "Quellians") for other in ("Zorbians", "Quellians")])
    spread_, models = {}, {}
    for weight in (0.0, 1.0, 10.0):
        models[weight] = toxicity.fit(docs, truth, counterfactual=weight)
        spread_[weight] = float(np.ptp(models[weight].score_texts(neutral)))
    assert set(models[10.0].names) == {"zorbians", "quellians"} and models[10.0].swapped == sum(1 for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5)
    assert spread_[10.0] < 0.25 * spread_[0.0] and spread_[1.0] < 0.5 * spread_[0.0]  # 1 is the strength by default
    assert models[10.0].score_texts(pa.array(["The Quellians said: moron"]))[0] > 0.5 > models[10.0].score_texts(neutral).max()


def test_scores_of_odd_tables(spark):
    """Null and repeated ids, null, empty and long texts, clashing names; a score is the same wherever a text stands."""
    rows, labels = labelled(5, 200)
    odd = [(None, "the moron"), (None, None), (7, "the moron"), (7, "the moron"), (8, ""), (9, "word " * 300_000 + "moron")]
    docs = spark.createDataFrame([(i, t, 0.5, "q") for i, t in rows + odd], "doc_id bigint, text string, score double, q_stats string")
    truth = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, truth)
    got = [(r["text"], r["s"]) for r in docs.select("text", model.score()("text").alias("s")).collect()]
    assert len(got) == len(rows) + len(odd) and len({s for t, s in got if t == "the moron"}) == 1 and all(0 <= s <= 1 for _, s in got)
    assert len({s for t, s in got if not t}) == 1
    q = quality.fit(quality.training_rows(quality.with_statistics(docs), truth))
    kept = quality.keep_good(docs, q)
    assert kept.columns == docs.columns and {r["q_stats"] for r in kept.collect()} == {"q"}
    assert quality.keep_good(docs.limit(0), q).count() == 0


def test_classifiers_without_training_rows(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(quality.training_rows(quality.with_statistics(docs), none))
    assert [r["s"] for r in quality.with_statistics(docs).selectExpr(f"{model.score()} AS s").collect()] == [0.5, 0.5]
    assert [r["s"] for r in docs.select(toxicity.fit(docs, none).score()("text").alias("s")).collect()] == [0.5, 0.5]


def test_decontamination_of_short_and_numeric_items(spark):
    """Verbatim copies of items that are nearly all placeholders, or short, are found; the same templates with other values are not."""
    texts = ["What is 12 + 7 - 30 * 4 + 2 - 9 ?", "Solve: 14 + 35 = 49, 18 + 27 = 45, 36 + 47 = ?", "Compute 3 4 5 6 7 8 9 10 11 12 13 14", "What is 7 + 5?", "12 km + 30 km"]
    items = spark.createDataFrame(list(enumerate(texts)), BENCHMARK)
    copies = [(k, f"alpha beta. {t} gamma") for k, t in enumerate(texts)]
    others = [(10 + k, "".join("8" if c.isdigit() else c for c in t)) for k, (_, t) in enumerate(copies)]
    for block in (500_000, 3):
        got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.matches(frame(spark, copies + others), items, block=block).collect()}
        assert got == {(k, k): True for k in range(len(texts))}


@pytest.mark.parametrize("text", ["Ein Händler verkauft am Montag 40 Kilo Äpfel und am Dienstag 25 Kilo Birnen auf der Straße, wie viel Obst hat Anna nach 7 Tagen", "What is 12 + 7 - 30 * 4 + 2 - 9 ?", "Call Anna Now"])
def test_decontamination_of_other_case_and_wrapping(spark, text):
    copies = [text, text.lower(), text.upper(), text.title(), text.replace(" ", "\n"), text.replace(" ", " \t \r\n    "), text.replace(" ", " ").lower()]
    items = spark.createDataFrame([(1, text), (2, text.lower())], BENCHMARK)
    docs = [(k, f"alpha beta {c} gamma") for k, c in enumerate(copies)] + [(100, "alpha Beta gamma"), (101, None)]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.matches(frame(spark, docs), items).collect()}
    assert got == {(k, i): True for k in range(len(copies)) for i in (1, 2)}


def test_decontamination_of_odd_tables_against_sql(spark, tmp_path):
    """Null and repeated ids, clashing names, long texts and names and numbers exchanged: as SQL says, in one block and in many."""
    import duckdb

    from tessera.llm import queries

    rng = random.Random(3)
    word = lambda: rng.choice(["river", "stone", "Anna", "Bert", "the", "of", "green", "letters", "7", "12", "3,5", "km", "kg", "%", "walked,", "then.", "München"])
    items = [(k % 23 if k % 9 else None, " ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 11, 30])))) for k in range(30)] + [(50, None), (51, " ... ")]
    swap = {"Anna": "Carl", "Bert": "Doris", "7": "8", "12": "99"}
    docs = [(1000, " ".join(word() for _ in range(20_000)))]
    for k, (_, text) in enumerate(items):
        some = " ".join(swap.get(w, w) for w in (text or "").split()) if k % 3 else text
        docs.append((k % 17 if k % 7 else None, f"a stranger said: {some}\n{' '.join(word() for _ in range(15))}"))
    docs += [docs[3], (None, None), (5, "")]
    table = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(docs)], "doc_id bigint, text string, item_id string, d_leaked int")
    known = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    expected = order(db.execute(queries.ORACLE_SQL["op8_decontamination"]).fetchall())
    assert order(queries.op8_decontamination(spark, str(tmp_path)).collect()) == expected and len(expected) > 20
    assert order(decontaminate.matches(table, known, block=40).collect()) == expected
    leaked = {r[0] for r in expected if r[0] is not None}
    kept = decontaminate.clean(table, known)
    assert kept.columns == table.columns and sorted(r["d_leaked"] for r in kept.collect()) == [k for k, (i, _) in enumerate(docs) if i not in leaked]
    assert decontaminate.matches(table.limit(0), known).count() == 0 and decontaminate.clean(table, known.limit(0)).count() == len(docs)
