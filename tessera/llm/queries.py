"""The thin queries opN_<name>: each applies its operator to its whole table and digests the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, html, jaccard, media, merkle, quality, secrets, substring, toxicity, trie, warc
from tessera.llm.storage import new_path, spread, store

HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) AS bigint) AS n_bytes", "text")
    kept = store(media.store_texts(spread(docs)).drop("text"), "media")  # the table of pictures, from which all else is read
    found = media.read_media(kept.df)
    own = ["cast(octet_length(media) AS bigint) AS media_bytes", "sha2(media, 256) AS media_sha256"]
    return found.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *own, "feature")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    found = found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", bpe.decoded("ids", path).alias("bytes"))
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = store(quality.with_statistics(docs).select("doc_id", "q"), "statistics").df
    model = quality.fit(quality.training_rows(found, table(spark, sf_dir, "labels")))
    out = found.selectExpr("doc_id", f"{HELD_OUT} AS held_out", f"{model.score()} AS score")
    return out.withColumn("predicted", F.expr("cast(score >= 0.3 AS int)"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), model.score()("text").alias("score"))
    return out.withColumn("predicted", F.expr("cast(score >= 0.5 AS int)"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(more)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return merkle.manifest(docs, "crc32(cast(doc_id AS string)) % 2 = 0", "replace(text, '\n', '')")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", secrets.scanned("text").alias("s")).select("doc_id", "s.*")
    return found.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(base, 256) AS base_sha256", "spans")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_media_columns": op2_media_columns,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scans": op13_secret_scans,
}

_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEADER = "CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 6 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 4 END + 6"
_CONFLICT = r"regexp_matches(text, '\\(### |</turn>)') OR regexp_matches(text, '</turn>(\n|$)')"

_NAMES = r"regexp_replace({}, '([\p{{L}}\p{{N}},;][\s\x0B\p{{Z}}]{{1,4}})(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g')"
_NUMBER = "{0} >= '0' AND {0} < ':'"
_PLAIN = "if(starts_with(t, chr(1) || 'm'), t[3:], t)"
#: Twice, since a name of two letters ends where the next one's context begins.
_RAW = f"""list_transform(w, lambda t, i: CASE WHEN {_NUMBER.format('t')} THEN chr(1) || 'n' || t WHEN starts_with(t, chr(1)) THEN chr(1) || 'm' || t[2:]
        WHEN i > 1 AND list_contains([{', '.join("'" + u + "'" for u in decontaminate.UNITS)}], t) AND {_NUMBER.format('w[i - 1]')} THEN chr(1) || 'u' || t ELSE t END)"""


def _windows_sql(tokens: str) -> str:
    """id, p, size, win and key of the windows of ``tokens`` (id, r, n, size)."""
    at = f"(SELECT id, n, size, p, list_slice(r, p + 1, p + size) AS win FROM (SELECT id, r, n, size, unnest(range(0, n - size + 1)) AS p FROM {tokens}))"
    counted = f"(SELECT *, len(list_filter(win, lambda t: NOT starts_with(t, chr(1)))) AS l, len(list_filter(win, lambda t: starts_with(t, chr(1) || 'm'))) AS m FROM {at})"
    joined = lambda of: f"array_to_string(list_transform(win, lambda t: {of}), ' ')"
    named = joined("CASE WHEN NOT starts_with(t, chr(1)) THEN t WHEN starts_with(t, chr(1) || 'm') THEN t[3:] ELSE t[1:2] END")
    return f"""SELECT id, n, size, p, win, unnest([if(size < 5 OR l + m < least(4, size - 1), {joined(_PLAIN)}, {named}),
        if(m > 0 AND NOT (size < 5 OR l < least(4, size - 1)), {joined("if(starts_with(t, chr(1)), t[1:2], t)")}, NULL)]) AS key FROM {counted}"""


def _tokens_sql(table: str) -> str:
    marked = _NAMES.format(_NAMES.format("coalesce(text, '')"))
    return f"SELECT id, {_RAW} AS r FROM (SELECT id, regexp_extract_all(lower(upper(replace({marked}, 'ß', 'ss'))), '{decontaminate.TOKEN}') AS w FROM {table})"


_LEAKS = f"""WITH items AS (SELECT id, r, len(r) AS n, least(len(r), 10) AS size FROM ({_tokens_sql("(SELECT DISTINCT item_id AS id, text FROM benchmark WHERE item_id IS NOT NULL)")}) WHERE len(r) > 0),
        docs AS (SELECT id, r, len(r) AS n FROM ({_tokens_sql("(SELECT DISTINCT doc_id AS id, text FROM documents)")})),
        sized AS (SELECT id, r, n, size FROM docs, (SELECT DISTINCT size FROM items) WHERE n >= size AND (size > 1 OR n = 1)),
        iw AS ({_windows_sql('items')}), dw AS ({_windows_sql('sized')}),
        met AS (SELECT d.id AS doc_id, i.id AS item_id, d.p - i.p AS shift, i.p AS i_pos, greatest(i.n - 9, 1) AS item_windows, list_transform(i.win, lambda t: {_PLAIN}) = list_transform(d.win, lambda t: {_PLAIN}) AS same,
        list_transform(list_filter(range(1, i.size + 1), lambda k: starts_with(i.win[k], chr(1))), lambda k: {{'i': list_transform([i.win[k]], lambda t: {_PLAIN})[1], 'd': list_transform([d.win[k]], lambda t: {_PLAIN})[1]}}) AS pairs FROM iw i JOIN dw d ON i.key = d.key AND i.size = d.size),
        aligned AS (SELECT doc_id, item_id, shift, item_windows, count(DISTINCT i_pos) AS n_windows, bool_or(same) AS some_same, bool_and(same) AS all_same, list_distinct(flatten(list(pairs))) AS pairs FROM met GROUP BY ALL)
        SELECT doc_id, item_id, max(n_windows) AS n_windows, max(item_windows)::INT AS item_windows, bool_or(all_same) AS exact FROM aligned
        WHERE some_same OR (n_windows >= least(3, item_windows) AND len(pairs) = len(list_distinct(list_transform(pairs, lambda x: x.i))) AND len(pairs) = len(list_distinct(list_transform(pairs, lambda x: x.d)))) GROUP BY doc_id, item_id"""

#: CRC-32 of the decimal digits of {0}, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(cast({0} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
        lambda s, c: list_reduce(list_concat([xor(s, c)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: xor(x >> 1, if(x & 1 = 1, 3988292384::UBIGINT, 0::UBIGINT)))), 4294967295::UBIGINT)"""

_TRIE = f"""WITH own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT conv_id, t, (({_CRC.format('conv_id')}) % 9)::BIGINT AS h FROM own),
        rebuilt AS (SELECT h.conv_id, if(h.conv_id % 5 = 0, h.t, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:])) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
        places AS (SELECT conv_id, d, t[1:d] AS path, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
        n AS (SELECT d AS depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, if(d = 0, 0, strlen(path[d].text)) AS size FROM places GROUP BY d, path),
        c AS (SELECT depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.depth = n.depth + 1 AND c.path = n.path)
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256 FROM k
        JOIN (SELECT a.depth, a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens FROM k a JOIN k b ON b.path[1:a.depth] = a.path GROUP BY ALL) s ON s.depth = k.depth AND s.path = k.path
        LEFT JOIN n p ON p.depth = k.depth - 1 AND p.path = k.path[1:k.depth - 1]"""

_LEAF = "sha256(concat(" + ", ".join("coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + "))"
_MERKLE = f"""WITH RECURSIVE docs AS (SELECT doc_id, source, leaf, if({_CRC.format('doc_id')} % 2 = 0, now, leaf) AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT *, {_LEAF.format('text')} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS now FROM documents)),
        low(l, source, pos, n, digest) AS (SELECT 0, source, pos, n, leaf FROM docs UNION ALL SELECT l + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY l, source, pos // 3, n),
        tops AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
        high(l, pos, n, digest) AS (SELECT 1000, pos, n, digest FROM tops UNION ALL SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY l, pos // 3, n),
        every AS (SELECT l, source, pos, n, digest FROM low WHERE n > 1 UNION ALL SELECT l, NULL, pos, n, digest FROM high WHERE n > 1),
        way(doc, now, l, source, pos, n, top) AS (SELECT d, now, 0, source, pos, n, top FROM (SELECT doc_id AS d, docs.now, docs.source, docs.pos, docs.n, tops.pos AS top FROM docs JOIN tops ON docs.source IS NOT DISTINCT FROM tops.source)
            UNION ALL SELECT doc, now, l, source, pos, n, top FROM (SELECT w.doc, CASE WHEN w.n > 1 THEN (SELECT sha256(string_agg(if(e.pos = w.pos, w.now, e.digest), '' ORDER BY e.pos)) FROM every e WHERE e.l = w.l AND (w.l >= 1000 OR e.source IS NOT DISTINCT FROM w.source) AND e.pos // 3 = w.pos // 3) ELSE w.now END AS now,
                CASE WHEN w.n > 1 THEN w.l + 1 ELSE 1000 END AS l, w.source, CASE WHEN w.n > 1 THEN w.pos // 3 ELSE w.top END AS pos, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE (SELECT count(*) FROM tops) END AS n, w.top FROM way w WHERE w.n > 1 OR w.l < 1000)),
        proof AS (SELECT w.doc, sha256(coalesce(string_agg(e.digest, '' ORDER BY e.l, e.pos), '')) AS proof FROM way w LEFT JOIN every e ON w.n > 1 AND e.l = w.l AND (w.l >= 1000 OR e.source IS NOT DISTINCT FROM w.source) AND e.pos // 3 = w.pos // 3 AND e.pos <> w.pos GROUP BY w.doc)
        SELECT d.doc_id, d.leaf, t.digest AS subroot, r.digest AS root, p.proof AS proof_sha256, w.now AS folded_root, w.now = r.digest AS verified FROM docs d JOIN tops t ON d.source IS NOT DISTINCT FROM t.source
        JOIN proof p ON p.doc = d.doc_id JOIN way w ON w.doc = d.doc_id AND w.l >= 1000 AND w.n = 1, (SELECT digest FROM high WHERE n = 1) r"""

#: For DuckDB, where SQL expresses the result; the learned, compressed and tokenised ones are tested in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o.c >= 75 * (x.c + y.c - o.c)),
        sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, root FROM reach JOIN sym ON sym.a = node AND root < sym.b)
        SELECT doc_id, coalesce(c, 0) AS n_shingles, component_id FROM (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) LEFT JOIN n USING (doc_id)""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM windows) WHERE rn > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
        places AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS t, count(*) AS n FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 10 * (i // 8) + 1, 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
        if(place = 1, 'response', 'revisit') AS record_type, if(place = 1, NULL, first) AS refers_to FROM d""",
    "op8_decontamination": _LEAKS,
    "op10_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
        s AS (SELECT *, {_HEADER} + length(text) + if({_CONFLICT}, len(regexp_extract_all(text, '### |</turn>')), 0) + 9 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars FROM s GROUP BY conv_id""",
    "op11_conversation_trie": _TRIE,
    "op12_merkle_manifest": _MERKLE,
}
