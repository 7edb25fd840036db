import hashlib
import re

import public_tokenizers
import sentencepiece
from test_pii import brute as brute_pii
from test_text_join import brute as brute_groups

import corpus_pipeline
from vitrina.llm import decontamination, quality, text_join


def test_stages_against_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = quality.classify(docs, spark.read.parquet(f"{data_dir}/labels.parquet")).collect()
    left = [(r.doc_id, r.text) for r in scores if r.score >= 0.3]
    left = [(k, rows[k].text) for k, _, c in brute_groups(left, 5, 80, 100) if k == c]
    index = decontamination.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()])
    plain = [" ".join(ws) for ws in index.words]
    leaks = {k for k, t in left for p in plain if f" {p} " in " " + " ".join(decontamination.words(t)) + " "}
    assert leaks and 0 < len(left) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for k, text in left:
        if k not in leaks:
            out, at = "", 0
            for s, e, kind in sorted((s, e, kind) for kind, s, e in brute_pii(text)):
                out += text[at : max(s, at)] + (f"[{kind}]" if s >= at else "")
                at = max(at, e)
            want[k] = out + text[at:]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, data_dir).collect()}
    assert got.keys() == want.keys()
    for k, text in want.items():
        ids = library.encode(text)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), k
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert any(re.search(r"\[(email|ip|card|phone)\]", t) for t in want.values())


def test_each_stage_returns_the_columns_of_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), data_dir).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "b"), (3, text, "a"), (3, text, "a"), (1, text + " x", "c"), (2, "other words here", "d"), (2, None, "e"), (None, "null id", "f"), (4, "", "g"), (1, "a row of the same id", "h"), (5, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in text_join.keep_first(docs).collect()), key=repr)
    assert got == sorted([rows[i] for i in (3, 4, 5, 6, 7, 8)], key=repr)
    twice = text_join.keep_first(docs.where("doc_id = 3")).collect()
    assert [tuple(r) for r in twice] == [(3, text, "a")]
