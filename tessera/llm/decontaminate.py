"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes tokens: words in lower case, numbers, and per cent signs; punctuation and kinds of white space go. Numbers,
units after a number, and names (capitalised words inside a sentence) are typed placeholders that keep their value. Windows
of canonical tokens are hashed and joined with the benchmark's, with names as plain words, so that a copy in other case or
wrapped otherwise meets its item, and where a window holds names also with names as placeholders. Matches of a document and
an item at one distance form an alignment. It counts if a window is equal in its values too, or if three windows (all, of a
shorter item) are equal as templates and the values were exchanged consistently: one value of the item always stands for one
value of the document, and the other way round. That catches questions with new parameters.

Each row of the benchmark's index is a hash and three numbers. It is broadcast in blocks of at most ``block`` rows, so its
size is bounded whatever the benchmark's; a larger benchmark means more passes over the corpus and the same rows. No text
of a document is shuffled: what meets the index leaves as the window's own tokens.

Items shorter than a window are one window of their own length. A window with fewer than 4 literal tokens, and an item below
``least`` tokens, says little as a template and is hashed with its values, so it meets only its verbatim copies. An item of
a single token is met only by documents of that one token.

Defined cases: a null text has no tokens; an item or document that occurs again gives its rows once; a null document id
is reported as null, a null item id is not searched; an empty benchmark or corpus gives no rows; a very long text is one row
whose windows are made one by one; extra columns, also of clashing names, play no part and are kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import store

#: Units that count as such after a number.
UNITS = (
    "% percent km m cm mm miles mile feet foot inches inch kg g mg grams gram lb pounds pound oz tons ton l ml liters litres liter litre "
    "s ms seconds second min minutes minute h hours hour days day weeks week months month years year dollars dollar euros euro cents cent usd eur gbp mph kmh degrees"
).split()
_MARK = "\u0001"
#: A word, perhaps marked as a name; a number; a per cent sign.
TOKEN = r"\x01?[\p{L}\p{M}\p{Nl}\p{No}]+|\p{Nd}+(?:[.,]\p{Nd}+)*|%"
#: Where a name begins inside a sentence.
NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;][\s\p{Z}]{1,4})"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(column: str) -> str:
    """SQL: the tokens of a text. A placeholder is \\u0001, its kind (n, m, u) and its value."""
    marked = f"regexp_replace(coalesce({column}, ''), {_text(NAME)}, '{_MARK}')"
    # a sharp s is written SS in upper case
    words = f"regexp_extract_all(lower(upper({marked})), {_text(TOKEN)}, 0)"
    number = "{0} >= '0' AND {0} < ':'"
    units = ", ".join(_text(u) for u in UNITS)
    kinds = f"CASE WHEN {number.format('t')} THEN concat('{_MARK}n', t) WHEN startswith(t, '{_MARK}') THEN concat('{_MARK}m', substr(t, 2)) WHEN i > 0 AND t IN ({units}) AND {number.format('w[i - 1]')} THEN concat('{_MARK}u', t) ELSE t END"
    return f"element_at(transform(array({words}), w -> transform(w, (t, i) -> {kinds})), 1)"


def _value(token: str) -> str:
    """SQL: a token with its value; a name is the plain word, since only its case makes it a name."""
    return f"if(startswith({token}, '{_MARK}m'), substr({token}, 3), {token})"


def _tokenised(table: DataFrame, key: str) -> DataFrame:
    """d_id, d_raw (the tokens with their values) and d_kinds, a letter for each: l, m (a name) or v (a number or unit)."""
    own = table.selectExpr(f"{key} AS d_id", f"{_tokens('text')} AS d_raw")
    kinds = f"array_join(transform(d_raw, t -> if(startswith(t, '{_MARK}'), if(startswith(t, '{_MARK}m'), 'm', 'v'), 'l')), '')"
    return own.select("d_id", "d_raw", F.expr(f"cast({kinds} AS binary)").alias("d_kinds"))


def _windows(tokens: DataFrame, lengths: list[int], least: int) -> DataFrame:
    """d_id, d_raw, pos, size and hash of every window of ``lengths`` canonical tokens.

    d_raw stands beside every window; a join in the same stage drops it with the windows that meet nothing, uncopied. The
    windows of a text with names are gone through twice: with names as words, then, where there are some, as placeholders.
    """
    plain = f"NOT startswith(t, '{_MARK}')"
    hashed = tokens.selectExpr(
        "d_id", "d_raw", "d_kinds", "instr(cast(d_kinds AS string), 'm') > 0 AS d_names", "ltrim('l', cast(d_kinds AS string)) = '' AS d_literal",
        f"transform(d_raw, t -> xxhash64(CASE WHEN {plain} THEN t WHEN startswith(t, '{_MARK}m') THEN substr(t, 3) ELSE substr(t, 1, 2) END)) AS d_named",
    )
    # further hashes only where they are needed
    hashed = hashed.withColumn("d_template", F.expr(f"if(d_names, transform(d_raw, t -> xxhash64(if({plain}, t, substr(t, 1, 2)))), NULL)"))
    valued = f"transform(d_raw, t -> xxhash64({_value('t')}))"
    hashed = hashed.withColumn("d_exact", F.expr(f"if(d_literal, d_named, {valued})"))
    sized = hashed.withColumn("size", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    sized = sized.withColumn("d_n", F.expr("size(d_raw) - size + 1")).filter("d_n > 0 AND (size > 1 OR d_n = 1)")
    at = sized.withColumn("at", F.explode(F.expr("sequence(0, if(d_names, 2 * d_n, d_n) - 1)")))
    at = at.selectExpr("d_id", "d_raw", "d_named", "d_template", "d_exact", "d_literal", "size", "at % d_n AS pos", "at >= d_n AS as_names", "if(d_literal, NULL, cast(substring(d_kinds, at % d_n + 1, size) AS string)) AS kinds")
    few = f"size < {least} OR NOT d_literal AND size - length(translate(kinds, '{{}}', '')) < least(4, size - 1)"
    cut = lambda array: f"xxhash64(size, slice({array}, pos + 1, size))"
    named = f"if({few.format('lm')}, {cut('d_exact')}, {cut('d_named')})"
    template = f"if(instr(kinds, 'm') > 0 AND NOT ({few.format('l')}), {cut('d_template')}, 0L)"
    # 0 stands for no window, and is never null, so that a join need not look at the hash twice
    return at.select("d_id", "d_raw", "pos", "size", F.expr(f"if(as_names, {template}, {named})").alias("hash"))


#: A window's tokens. Pairs of values stand where the item has placeholders.
_WINDOW = "slice(d_raw, pos + 1, size)"
_PAIRS = f"transform(filter(arrays_zip(i_window, window), p -> startswith(p.i_window, '{_MARK}')), p -> struct({_value('p.i_window')} AS i_slots, {_value('p.window')} AS slots))"
_SAME = f"transform(i_window, t -> {_value('t')}) = transform(window, t -> {_value('t')})"


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, least: int = 5, block: int = 500_000) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows and exact of every leaked pair."""
    items = store(_tokenised(benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct(), "item_id").filter("size(d_raw) > 0"), "items").df
    own = F.expr(f"least(size(d_raw), {size})").alias("n")
    short = {r["n"] for r in items.select(own).distinct().collect()} - {size}  # fewer than ``size`` values
    lengths = sorted({*short, size})
    known = _windows(items, lengths, least).filter(f"hash <> 0 AND size = least(size(d_raw), {size})")
    known = store(known.selectExpr("d_id AS item_id", "pos AS i_pos", "hash AS i_hash", f"{_WINDOW} AS i_window", f"greatest(size(d_raw) - {size - 1}, 1) AS item_windows"), "index").df
    index = known.select("i_hash", "item_id", "i_pos")
    blocks = max(1, -(-known.count() // block))
    tokens = _tokenised(docs.select("doc_id", "text"), "doc_id")
    met = []
    for k in range(blocks):
        own = index if blocks == 1 else index.filter(f"pmod(xxhash64(i_hash), {blocks}) = {k}")
        hits = _windows(tokens, lengths, least).join(F.broadcast(own), F.expr("hash = i_hash"))
        met.append(hits.selectExpr("d_id AS doc_id", "item_id", "i_pos", "pos - i_pos AS shift", "i_hash", f"{_WINDOW} AS window"))
    # a hash may stand for an item's window with names and for another one, so the window is found by all three
    met = reduce(DataFrame.unionAll, met).join(known, ["item_id", "i_pos", "i_hash"])
    met = met.filter("size(window) = size(i_window)").selectExpr("doc_id", "item_id", "shift", "i_pos", "item_windows", f"{_SAME} AS same", f"{_PAIRS} AS pairs")
    aligned = met.groupBy("doc_id", "item_id", "shift", "item_windows").agg(
        F.countDistinct("i_pos").alias("n_windows"), F.expr("bool_or(same)").alias("some_same"), F.expr("bool_and(same)").alias("all_same"),
        F.expr("array_distinct(flatten(collect_set(pairs)))").alias("pairs"),
    )
    consistent = "size(pairs) = size(array_distinct(pairs.i_slots)) AND size(pairs) = size(array_distinct(pairs.slots))"
    leaked = aligned.filter(f"some_same OR (n_windows >= least(3, item_windows) AND {consistent})")
    return leaked.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.expr("bool_or(all_same)").alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a leaked item, with their columns; rows without an id stay."""
    leaked = matches(docs, benchmark, size).filter("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
