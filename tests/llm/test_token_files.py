import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vitrina.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Hello World's  don't 123 a1b2 été ÉTÉ <|endoftext|> á x", "ΣΑΣ İ", "a\xa0b\x1cc\x85d", "«¡Hola!» ¿qué? ß×÷", "'street 'sss ''s", "x" * 3000, "1234 ½ ² ª º µ", "a\r\n\tb", "你好 😀", "<|", "aaaa " * 500, "don`t 's'd"]


def test_equals_the_library():
    t, e = Tokenizer.from_file(PATH), tf.WordEncoder(PATH, 2)
    for text, ids in zip(ODD, e.ids(ODD), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text


def test_blocks_round_trip_and_shrink():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50, rng.integers(1, 6)).astype(np.uint32) for _ in range(60)]
    for base in (50, 70_000):
        docs = [np.concatenate([words[i] for i in rng.zipf(1.5, rng.integers(1, 90)) % 60]) for _ in range(300)]
        docs += [np.array([7], np.uint32), np.full(999, 3, np.uint32)]
        data = tf.pack([None, *range(len(docs) - 1)], docs, base)
        b = tf.Block(data)
        assert b.doc_ids == [None, *range(len(docs) - 1)]
        assert b.all().tolist() == np.concatenate(docs).tolist()
        assert b.sizes().tolist() == [len(d) for d in docs]
        for k in (0, 5, len(docs) - 2, len(docs) - 1):
            assert b.one(k) == docs[k].tolist()
        assert len(b.rules) > 20 and len(b.symbols) < len(b.all()) / 2
        if len(b.rules):
            _, _, size = tf.expansions(b.rules, base)
            assert size.tolist() == b.rule_size.tolist()


def test_files(spark, data_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 20_000)
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(None, "null id"), (10**6, None), (10**6 + 1, "same"), (10**6 + 1, "same"), *((2 * 10**6 + i, x) for i, x in enumerate(ODD))], "doc_id long, text string")
    docs = docs.unionByName(odd)
    tf.write_token_files(docs, PATH, str(tmp_path / "f"))
    rows = sorted(tf.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: -1 if i is None else i)
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = 0
    for r in rows:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.token_ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark, tmp_path):
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string, shard int"), PATH, str(tmp_path / "e"))
    assert tf.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_clashing_columns_are_not_read(spark, tmp_path):
    rows = [(3, "one two"), (1, None), (2, "Three 4"), (2, "Three 4")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for name, df in (("a", plain), ("b", plain.selectExpr("*", "'x' AS start", "7 AS n_tokens", "'y' AS shard", "0 AS payload", "'z' AS k", "1 AS t"))):
        tf.write_token_files(df, PATH, str(tmp_path / name), end_id=2)
        out.append(sorted(map(tuple, tf.read_token_files(spark, str(tmp_path / name), ids=False).collect())))
    assert out[0] == out[1] and [r[0] for r in out[0]] == [1, 2, 2, 3] and [r[1] for r in out[0]] == sorted(r[1] for r in out[0])


def test_a_tokenizer_of_other_rules_is_refused(tmp_path):
    import json

    import pytest

    spec = json.loads(open(PATH).read())
    tf.WordEncoder(PATH, 2)
    spec["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="rules"):
        tf.WordEncoder(str(other), 2)
