"""Toxicity: a logistic classifier whose scores must not move when identity terms are swapped.

A text's features are the presence of terms and of their first 4, 5 and 6 bytes, which catches inflected insults. From a
bounded sample of labelled rows the features that occur much more often in toxic texts are chosen, beside those of all
identity terms. Identity terms are of two kinds: a fixed list of words for groups of people, and the names that stand for people
in the sample: words with a capital behind a title ("Dr"), behind "people from", before "people" or "community", or behind an
article and with the ending of a plural of origin or belief ("the ...ians"), so in ``support`` texts at least. A capital alone
is no sign of identity: it is as often that of a licence or a product. A corpus that mentions nobody has no identity term, and
the penalty then has nothing to act on (``Toxicity.swapped`` is 0). In every sampled sentence that has identity terms each is replaced by the next one of its kind, and the squared change of the sentence's log odds is
added to the class-balanced logistic loss and a ridge. So a name cannot carry weight that another name does not carry, and a
text is not toxic for whom it mentions. ``Toxicity.swapped`` tells how many sentences took part.

The sample is one table in the shared folder. Names and features are counted by tasks and added up by Spark; the driver gets
the chosen features, which of them each sampled text has, and the different changes that swaps make: no text.

Defined cases: a null text counts as empty and gets the score of a text without chosen terms; a very long text is read a
megabyte of rows at a time; labels other than 0 and 1 or null are not used; rows without an id, or with equal ids, are scored
one by one, and repeated label rows count once a row; without training rows of a class, every score is the share of label 1
(0.5 without any), also with empty ``documents``; ties in the sample's order are broken by the id; further columns, also of
clashing names, play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import store
from tessera.llm.wordhash import Words, slices, utf8, words

#: Terms of one kind stand together; a swap replaces each by the next one of its line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
# What stands beside a name of people, and the endings of plurals of origin and belief.
TITLES = frozenset("mr mrs ms miss dr prof sir lady lord rabbi imam herr frau monsieur madame mme señor señora don doña".split())
GROUPS = frozenset("people folks men women man woman girl boy person persons community communities immigrants refugees families gens personnes leute menschen gente personas".split())
FROM = frozenset("from of de aus von".split())
ARTICLES = frozenset("the these those all most many some les des ces die alle diese los las todos".split())
NAMES = 5000  # most names, of a sample of bounded size
ENDINGS = ("ans", "ists", "ites", "ese", "ois", "iens", "ains", "aner", "anos", "inos")
PREFIXES = (4, 5, 6)


def _term_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Term and hash of each term and of each of its prefixes."""
    terms, found = [np.arange(len(w.row))], [w.hashes()]
    for size in PREFIXES:
        long = np.flatnonzero((w.last - w.first) >= size)
        part = Words(w.text, w.first[long], w.first[long] + size, w.row[long], w.begin)
        terms.append(long)
        found.append(part.hashes() ^ np.uint64(size))
    return np.concatenate(terms), np.concatenate(found)


def _features_of(term: str) -> np.ndarray:
    return _term_hashes(words(*utf8(pa.array([term])), lower=True, terms=True))[1]


def _hash_of(term: str) -> int:
    return int(_features_of(term)[0])


def identity_swaps(names: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the hash of an identity term: its own features and those of the term that replaces it."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for kind in (*IDENTITY_TERMS, tuple(names)):
        features = [_features_of(term) for term in kind]
        for own, other in zip(features, features[1:] + features[:1], strict=True):
            out.setdefault(int(own[0]), (own, other))
    return out


_ENDS = np.isin(np.arange(256), list(b".!?\n"))


def _sentences(text: np.ndarray, w: Words) -> np.ndarray:
    """The sentence of each term: one more after each end mark, and with each text."""
    return np.concatenate(([0], np.cumsum(_ENDS[text], dtype=np.int64)))[w.first] + w.row


def _capital(text: np.ndarray, w: Words) -> np.ndarray:
    """Which terms have a capital, then a small letter."""
    second = text[np.minimum(w.first + 1, max(len(text) - 1, 0))]
    third = text[np.minimum(w.first + 2, max(len(text) - 1, 0))]
    small = lambda b: (b >= 0x61) & (b <= 0x7A) | (b >= 0x80)
    first = text[w.first]
    plain = (first >= 0x41) & (first <= 0x5A) & small(second) & (w.last - w.first >= 2)
    accented = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & small(third) & (w.last - w.first >= 3)
    return plain | accented


def _people(text: np.ndarray, w: Words):
    """Row and text of the terms with a capital that their neighbours mark as names of people."""
    sentence = _sentences(text, w)
    term = lambda k: w.text[w.first[k] : w.last[k]].tobytes().decode(errors="replace")

    def near(k: int, by: int, known: frozenset, apart: bool = False) -> bool:
        """Whether a neighbour is one of these, in the same sentence, or, of ``apart``, in the same text."""
        other = k + by
        if not 0 <= other < len(w.row) or w.row[other] != w.row[k]:
            return False
        return (apart or sentence[other] == sentence[k]) and term(other) in known

    for k in np.flatnonzero(_capital(text, w)).tolist():
        if (
            near(k, -1, TITLES, True)  # a title may end in a full stop
            or near(k, 1, GROUPS)
            or near(k, -1, FROM) and near(k, -2, GROUPS)
            or near(k, -1, ARTICLES) and term(k).endswith(ENDINGS)
        ):
            yield int(w.row[k]), term(k)


def _terms(column: pa.Array) -> tuple[np.ndarray, Words]:
    """The bytes of texts as they are, and their terms in lower case."""
    text, begin = utf8(column)
    return text, words(text, begin, lower=True, terms=True)


def _name_counts(batches):
    """(y, text) to (term, feature, n): in how many texts of the partition each name of people occurs."""
    found: Counter[str] = Counter()
    for batch in batches:
        for part in slices(batch, 1):
            text, w = _terms(part.column(1))
            found.update(term for _, term in set(_people(text, w)))
    hashes = pa.array(np.array([_hash_of(term) for term in found], np.uint64).view(np.int64))
    yield pa.record_batch([pa.array(found.keys(), pa.string()), hashes, pa.array(found.values(), pa.int64())], ["term", "feature", "n"])


def _distinct_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the different features of each text."""
    term, found = _term_hashes(w)
    row = w.row[term]
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def _feature_counts(batches):
    """(y, text) to (feature, toxic, other): in how many texts of either class each feature occurs, by partition."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for batch in batches:
        for part in slices(batch, 1):
            row, found = _distinct_features(_terms(part.column(1))[1])
            toxic = np.asarray(part.column(0), dtype=np.int64)[row]
            keys, at = np.unique(np.concatenate((keys, found)), return_inverse=True)
            more = np.concatenate((counts, np.column_stack((toxic, 1 - toxic)).reshape(-1, 2)))
            counts = np.column_stack([np.bincount(at, more[:, k], minlength=len(keys)) for k in (0, 1)]).astype(np.int64)
    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())], ["feature", "toxic", "other"])


def _design(features: np.ndarray, names: list[str]):
    """(y, text) to (kind, y, own): of each text its places among ``features``; of each swapped sentence the change, -1 for y."""

    def places(found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(features, found), len(features) - 1)
        return np.unique(at[features[at] == found]).astype("<i4")

    def changes(text: np.ndarray, w: Words, swaps: dict, fixed: np.ndarray, found_names: np.ndarray):
        hashes, sentence = w.hashes(), _sentences(text, w)
        mention = np.isin(hashes, fixed) | np.isin(hashes, found_names) & _capital(text, w)
        named = np.flatnonzero(mention)
        term, found = _term_hashes(w)
        order = np.argsort(term, kind="stable")
        found, cuts = found[order], np.searchsorted(term[order], np.arange(len(w.row) + 1))
        for s in np.unique(sentence[named]):
            lo, hi = np.searchsorted(sentence, (s, s + 1))
            before = found[cuts[lo] : cuts[hi]]
            parts = [swaps[int(hashes[k])][1] if mention[k] else found[cuts[k] : cuts[k + 1]] for k in range(lo, hi)]
            old, new = places(before), places(np.concatenate(parts))
            more, less = np.setdiff1d(new, old), np.setdiff1d(old, new)
            yield np.concatenate((more + 1, -(less + 1))).astype("<i4").tobytes()

    def design(batches):
        swaps = identity_swaps(names)
        fixed, found_names = (np.array(sorted(known), dtype=np.uint64) for known in (identity_swaps([]), {_hash_of(n) for n in names}))
        for batch in batches:
            for part in slices(batch, 1):
                text, w = _terms(part.column(1))
                row, found = _distinct_features(w)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = [places(found[cuts[k] : cuts[k + 1]]).tobytes() for k in range(part.num_rows)]
                y = part.column(0).to_pylist()
                moved = list(changes(text, w, swaps, fixed, found_names))
                columns = [pa.array(["text"] * len(own) + ["swap"] * len(moved)), pa.array(y + [-1] * len(moved), pa.int32()), pa.array(own + moved, pa.binary())]
                yield pa.record_batch(columns, ["kind", "y", "own"])

    return design


@dataclass
class Toxicity:
    """Sorted feature hashes, their weights, the intercept; how many sentences were swapped, and the names that were found."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    swapped: int = 0
    names: list[str] = field(default_factory=list)

    def score_texts(self, column: pa.Array) -> np.ndarray:
        w = words(*utf8(column), lower=True, terms=True)
        term, found = _term_hashes(w)
        row = w.row[term]
        at = np.searchsorted(self.features, found)
        at[at == len(self.features)] = 0
        hit = self.features[at] == found if len(self.features) else np.zeros(len(found), dtype=bool)
        keys = np.unique(row[hit] * np.int64(max(1, len(self.features))) + at[hit])
        odds = np.full(len(column), self.intercept)
        if len(keys):
            odds += np.bincount(keys // len(self.features), self.weights[keys % len(self.features)], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def score(self):
        """A scalar UDF from text to score."""

        @F.arrow_udf(T.DoubleType())
        def scored(text: pa.Array) -> pa.Array:
            parts = [self.score_texts(x.column(0)) for x in slices(pa.record_batch([text], ["t"]), 0)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return scored


def sample_labels(labels: DataFrame, label: str = "toxic", each: int = 4000) -> DataFrame:
    """At most ``each`` training rows of either class, by a hash of the id; the held-out fifth (crc32 modulo 5 is 0) is out."""
    known = labels.selectExpr("doc_id AS l_id", f"cast({label} AS int) AS y")
    known = known.filter("y IN (0, 1) AND l_id IS NOT NULL AND crc32(cast(l_id AS string)) % 5 <> 0")
    take = lambda y: known.filter(F.col("y") == y).orderBy(F.expr("xxhash64(l_id)"), "l_id").limit(each)
    return take(1).unionByName(take(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = 4000, support: int = 4, share: float = 0.002,
        ratio: float = 4.0, ridge: float = 1e-5, counterfactual: float = 1.0, steps: int = 600) -> Toxicity:
    """Learn from the sample of ``sample_labels``.

    support, share: a feature is chosen if it occurs in so many toxic sampled texts, and in that share of them; a name counts
    if it occurs in so many sampled texts. ratio: a feature occurs in so many times the share of other texts.
    counterfactual: weight of the mean squared change of log odds under the swap.
    """
    chosen = sample_labels(labels, label, each)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("y", "text")
    sample = store(rows, "toxicity-sample").df
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, n = sizes.get(1, 0), sum(sizes.values())
    if ones == 0 or ones == n:
        prior = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Toxicity(intercept=float(np.log(prior / (1 - prior))))
    counts = sample.mapInArrow(_feature_counts, "feature bigint, toxic bigint, other bigint").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    counts = store(counts, "toxicity-features").df
    named = sample.mapInArrow(_name_counts, "term string, feature bigint, n bigint").groupBy("term", "feature").agg(F.sum("n").alias("n")).filter(f"n >= {support}")
    names = [r["term"] for r in named.orderBy(F.desc("n"), "term").limit(NAMES).select("term").collect()]
    odds = f"((t + 0.5D) / {ones + 1}) / ((o + 0.5D) / {n - ones + 1})"
    good = counts.filter(f"t >= {max(support, math.ceil(share * ones))} AND {odds} >= {ratio}").select("feature").toPandas()["feature"].to_numpy(dtype=np.int64)
    features = np.union1d(good.view(np.uint64), np.concatenate([own for own, _ in identity_swaps(names).values()]))
    got = sample.mapInArrow(_design(features, names), "kind string, y int, own binary").groupBy("kind", "y", "own").count().toPandas()
    got = got.sort_values(["kind", "y", "own"])  # the result must not depend on the order of arrival
    text, swap = (got[got["kind"] == k] for k in ("text", "swap"))
    lists = lambda part: [np.frombuffer(b, "<i4") for b in part["own"]]
    w, b = _descend(len(features), lists(text), text["y"].to_numpy(np.int64), text["count"].to_numpy(float), lists(swap), swap["count"].to_numpy(float), ridge, counterfactual, steps)
    return Toxicity(features, w, b, int(swap["count"].sum()), names)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.concatenate(lists) if lists else np.zeros(0, np.int32)


def _descend(k: int, texts, y, times, swaps, swap_times, ridge, counterfactual, steps) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps. texts: places of features; swaps: places from 1, negative where they go."""
    r, c = _flat(texts)
    sr, sc = _flat(swaps)
    sign, sc = np.sign(sc).astype(float), np.abs(sc) - 1
    ones, zeros = times[y == 1].sum(), times[y == 0].sum()
    weight = times * np.where(y == 1, 0.5 / ones, 0.5 / zeros)
    share = swap_times / max(swap_times.sum(), 1)
    w, b = np.zeros(k), 0.0
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], minlength=len(texts))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(c, g[r], minlength=k) + ridge * w
        if len(swaps):
            change = np.bincount(sr, sign * w[sc], minlength=len(swaps))
            grad += counterfactual * 2 * np.bincount(sc, sign * (share * change)[sr], minlength=k)
        step = np.append(grad, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * step, 0.999 * m2 + 0.001 * step**2
        move = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)
