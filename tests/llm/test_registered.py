"""The registered queries, and the pipeline stage by stage against brute force."""

import re


import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_documents import DOCS, brute_components, brute_removal, corpus, frame, labelled


def test_all_are_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    good, labels = labelled(12, 60)
    rows = [(1000 + i, t) for i, t in good] + corpus(4, 16)
    question = "this question of the benchmark has more than a dozen words and is found again in a document"
    rows.append((5000, "water " * 3 + question + " green letter"))
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # nulls, repeated rows and labels of no document play no part, or count again
    odd = [(None, 0, 1), (1000, None, None), (777_777, 0, 0), (1001, 2, 2)] + [(1000 + i, q, t) for i, q, t in labels[:5]]
    spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + odd, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question), (1, question), (None, "water green letter stone water green letter"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in got.collect()]
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in got.collect()}
        if name != "byte_bpe":
            assert got.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
        if name == "ngram_jaccard":
            assert set(after) == {i for i, (_, c) in brute_components(before).items() if i == c}
        if name == "substring_dedup":
            expected = brute_removal(before)
            assert {i: (r["text"] or "").split() for i, r in after.items()} == {i: [w for w in e[3]] for i, e in expected.items() if e[3] or not e[1]}
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "decontamination":
            assert {i for i, _ in before} - set(after) == {5000}
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in before} and got.filter("n_tokens < 0").count() == 0
    # the last stage's digests are those of the library's ids and of the texts themselves
    import hashlib

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(before)
    for r in got.collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
