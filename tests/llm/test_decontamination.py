import random

import pytest

from vitrina.llm import decontamination as dc


def brute(texts, index, threshold, question, answer):
    out = {}
    for d, t in enumerate(texts):
        ws = dc.words(t)
        for start in range(0, len(ws), index.longest):
            passage = ws[start : start + 2 * index.longest]
            terms = {index.vocabulary[w] for w in passage if w in index.vocabulary}
            for item in range(len(index.ids)):
                score = sum(x for t in terms for i, x in index.posting(t) if i == item)
                if score >= threshold - 1e-9:
                    q, a = dc.overlap(passage, index.item_words(item))
                    if q >= question and a >= answer:
                        out[d, index.ids[item]] = max(out.get((d, index.ids[item]), (0, 0, 0)), (q, a, score))
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6])
@pytest.mark.parametrize("block", [1, 4, 64])
def test_wand_finds_all_above_the_threshold(monkeypatch, threshold, block):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", block)
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(90)]
    index = dc.Index(items)
    texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 90)), *(items[rng.randrange(90)][1].split() if rng.random() < 0.5 else []), *rng.choices(vocabulary, k=20)]) for _ in range(40)]
    for t in texts:
        terms = sorted({index.vocabulary[w] for w in dc.words(t) if w in index.vocabulary})
        want = {}
        for x in terms:
            for i, share in index.posting(x):
                want[i] = want.get(i, 0) + share
        got = dict(index.search(terms, threshold))
        assert got.keys() == {i for i, s in want.items() if s >= threshold - 1e-9}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
    got = {(d, i): (q, a) for d, i, _, q, a in index.matches([dc.words(t) for t in texts], threshold, 0.5, 0.5)}
    assert got == {k: v[:2] for k, v in brute(texts, index, threshold, 0.5, 0.5).items()}


def test_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    plain = {r.item_id: " ".join(dc.words(r.text)) for r in items.collect()}
    texts = {r.doc_id: " " + " ".join(dc.words(r.text)) + " " for r in docs.collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, p in plain.items() if f" {p} " in t}
    found = {(r.doc_id, r.item_id) for r in dc.find(docs, items).collect()}
    assert verbatim and verbatim <= found
    left = {r.doc_id for r in dc.clean(docs, items).collect()}
    assert left == texts.keys() - {d for d, _ in found}


def test_light_edits_are_found_and_clean_text_is_left(spark):
    rng = random.Random(5)
    item = [f"term{i}" for i in range(40)]
    edited = [w for w in item if w not in ("term7", "term30")]
    filler = [f"f{i}" for i in range(500)]
    rows = [(1, " ".join(filler + edited + filler)), (2, " ".join(filler)), (3, " ".join(rng.sample(item, 12))), (4, None), (5, ""), (1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score")
    items = spark.createDataFrame([(9, " ".join(item)), (8, " ".join(item)), (7, ""), (6, None)], "item_id long, text string")
    got = dc.find(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 8), (1, 8), (1, 9), (1, 9)]
    assert dc.find(docs, items.limit(0)).count() == 0 and dc.find(docs.limit(0), items).count() == 0
    assert dc.clean(docs, items).columns == docs.columns
    assert sorted(r.doc_id for r in dc.clean(docs, items).collect()) == [2, 3, 4, 5]


def test_items_in_blocks(spark, data_dir, monkeypatch):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in dc.find(docs, items).collect()}
    monkeypatch.setattr(dc, "INDEX_ITEMS", 15)
    assert {(r.doc_id, r.item_id) for r in dc.find(docs, items).collect()} == whole


def test_results_do_not_depend_on_the_size_of_an_index(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 90)))) for i in range(60)] + [(60, ""), (61, None)]
    texts = []
    for i in range(240):
        ws = items[i % 60][1].split()
        kept = [w for w in ws if rng.random() < rng.choice([0.5, 0.6, 0.7, 0.8])]
        texts.append((i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 60)), *kept, *rng.choices(vocabulary, k=rng.randint(0, 60))])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    options = {"threshold": 0.7, "question": 0.3, "answer": 0.5}
    whole = sorted(tuple(r) for r in dc.find(docs, benchmark, **options).collect())
    left = sorted(tuple(r) for r in dc.clean(docs, benchmark, **options).collect())
    assert 40 < len(whole) and 0 < len(left) < 240
    monkeypatch.setattr(dc, "INDEX_ITEMS", 5)
    monkeypatch.setattr(dc, "INDEXES", 3)
    assert sorted(tuple(r) for r in dc.find(docs, benchmark, **options).collect()) == whole
    assert sorted(tuple(r) for r in dc.clean(docs, benchmark, **options).collect()) == left


def test_short_items_stand_word_for_word(spark):
    items = [(1, "the"), (2, "of the"), (3, "name the capital"), (4, "which river is the longest"), (5, " ".join(f"q{i}" for i in range(300)))]
    rows = [(1, "the of the and of the"), (2, "please name the capital of it"), (3, "capital the name"), (4, "the longest is which river"), (5, "Which river is the longest?"), (6, " ".join(f"q{i}" for i in range(300)))]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.find(docs, benchmark).collect()) == [(2, 3), (5, 4), (6, 5)]


def test_one_long_item_leaves_the_passages_of_short_ones():
    # The words of a short item strewn over a long text are in no passage of its length.
    short = [f"s{i}" for i in range(20)]
    strewn = [w for s in short for w in [s, *(f"x{s}{k}" for k in range(40))]]
    indexes = [dc.Index([(1, " ".join(short))]), dc.Index([(2, " ".join(f"q{i}" for i in range(3000)))])]
    assert [m for index in indexes for m in index.matches([strewn], 0.5, 0.0, 0.0)] == [] and (dc.group(20), dc.group(65), dc.group(3000)) == (0, 1, 3)


def test_many_long_items_in_bounded_indexes(spark, monkeypatch):
    """Items of thousands of words: each index is bounded by words, and what is found does not depend on the bound."""
    import pickle
    import random

    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(2000))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, f"before {items[i * 7][1]} after") for i in range(8)] + [(100, items[3][1][:3000]), (101, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(dc, "INDEX_WORDS", 10_000)
    passes = [[pickle.loads(data.value) for _, data in shared] for shared in dc.indexes(bench)]
    sizes = [(len(index.tokens), len(pickle.dumps(index))) for shared in passes for index in shared]
    assert len(passes) == 2 and sum(n for n, _ in sizes) == 120_000 and max(n for n, _ in sizes) <= 24_000 and max(b for _, b in sizes) < 200 * 24_000
    got = sorted((r.doc_id, r.item_id) for r in dc.find(docs, bench).collect())
    monkeypatch.setattr(dc, "INDEX_WORDS", 10_000_000)
    assert got == [(i, i * 7) for i in range(8)] == sorted((r.doc_id, r.item_id) for r in dc.find(docs, bench).collect())
