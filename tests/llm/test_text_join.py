import random

import numpy as np
import pytest

from vitrina.llm import text_join as tj


def grams(text, n):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, len(sets[i]), least.get(top(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed, docs=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = rng.choices(vocabulary, k=40)
    out = []
    while len(out) < docs:
        ws = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 200]))
        if rng.random() < 0.4:
            ws = shared + ws[:20]
        out.append(ws)
        while rng.random() < 0.7:
            ws = list(ws)
            for _ in range(rng.randint(0, max(1, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            out.append(ws if rng.random() < 0.8 else ws[: len(ws) * 9 // 10 + 1])
    rng.shuffle(out)
    return [" ".join(w.upper() if rng.random() < 0.1 else w for w in ws) for ws in out]


@pytest.mark.parametrize(("n", "num", "den", "part"), [(4, 85, 100, tj.PART_BYTES), (5, 80, 100, 5 * tj.POINT_BYTES)])
def test_equals_brute_force(spark, monkeypatch, n, num, den, part):
    monkeypatch.setattr(tj, "PART_BYTES", part)
    texts = [*corpus(n), "", None, " \n\t", "a\xa0b c", "a\xa0b c", "é É", "A b\x0bC\x0cd", "a b c d"]
    data = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "null key"), (None, ""), (6, texts[2]), (6, texts[5])]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS component_id", "'x' AS c")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in tj.classify(df, n, num, den).collect()), key=repr)
    assert got == brute(data, n, num, den)
    assert len({g[2] for g in got}) < len(got) * 0.8


def test_chains_link_through_meetings(spark):
    # Each text links with the next only, and the smallest hash is no hub of the chain.
    words = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(words[i * 3 : i * 3 + 120])) for i in range(40)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in tj.classify(spark.createDataFrame(data, "doc_id long, text string"), 4, 85, 100).collect()), key=repr)
    assert got == brute(data, 4, 85, 100) and {g[2] for g in got} == {0}


def test_empty_table(spark):
    assert tj.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for num, den in ((85, 100), (80, 100)):
        spec = tj.Blocks(num, den)
        for _ in range(800):
            size = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            most = spec.differ(len(a))
            drop = int(rng.integers(0, most + 1))
            b = np.unique(np.r_[a[drop:], rng.integers(0, 2**64, int(rng.integers(0, most + 1)), np.uint64)])
            if tj.linked(a, b, num, den) and len(np.setxor1d(a, b)):
                assert np.intersect1d(spec.keys(a), spec.keys(b)).size
                assert tj.may_link(tj.point(a), tj.point(b), len(a), len(b), num, den)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100)])
def test_every_size_shares_a_key_with_its_smallest_partner(num, den):
    # A text and the same text with n-grams appended, as many as a link allows.
    rng = np.random.default_rng(4)
    spec = tj.Blocks(num, den)
    for size in [*range(2, 700), *range(1150, 1165), *range(1850, 1856), *range(7590, 7596)]:
        least = -(-num * size // den)
        for part in {least, (least + size) // 2, size - 1} & set(range(least, size)):
            for _ in range(3):
                a = rng.integers(0, 2**64, size, np.uint64)
                assert tj.linked(np.sort(a), np.sort(a[:part]), num, den)
                assert np.intersect1d(spec.keys(np.sort(a)), spec.keys(np.sort(a[:part]))).size, (size, part)


def test_appended_words_link(spark):
    rows, rng = [], random.Random(6)
    for size in (23, 24) * 30:
        ws = [f"v{rng.randrange(10**9)}" for _ in range(size + 3)]
        rows += [(len(rows), " ".join(ws)), (len(rows) + 1, " ".join(ws[: -(-85 * size // 100) + 3]))]
    got = tj.classify(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k, _ in rows}


def test_tree_leaves_out_no_link():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**64, int(rng.integers(5, 60)), np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.r_[s[rng.integers(0, 3) :], rng.integers(0, 2**64, 1, np.uint64)]) for s in base for _ in range(4)]
    points, sizes = np.stack([tj.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = tj.RTree(points, sizes)
    pairs = [p for i, j in tree.search(85, 100, lambda i, j: np.ones(len(i), bool)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(set(pairs)) == len(pairs)
    for i, s in enumerate(sets):
        found = {j for a, j in pairs if a == i}
        assert found == {j for j in range(len(sets)) if tj.may_link(points[i], points[j], sizes[i], sizes[j], 85, 100)}
        assert found >= {j for j, t in enumerate(sets) if tj.linked(s, t, 85, 100)}


def test_a_meeting_gives_a_forest_not_its_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.r_[base[2:], rng.integers(0, 2**64, 2, np.uint64)]) for _ in range(700)]
    alone, groups, side = np.unique(rng.integers(0, 2**64, 300, np.uint64)), np.arange(701), np.zeros(701, np.int32)
    kept = tj.linking(groups, [*sets, alone], side, 85, 100)
    assert len(kept) == 699 and all(700 not in p for p in kept)
    points, sizes = np.stack([tj.point(s) for s in [*sets, alone]]), np.array([len(s) for s in [*sets, alone]])
    marked = tj.partnered(groups, sizes, points, side, 85, 100)
    assert marked[:700].all() and not marked[700]
    assert tj.linking(np.zeros(701, np.int64), [*sets, alone], side, 85, 100) == []
    # Of a split meeting a task links across its two sides only.
    side[::2] = 1
    assert all(side[a] != side[b] for a, b in tj.linking(groups, [*sets, alone], side, 85, 100))


def test_sets_of_any_white_space():
    texts = [None, "", " \t\n", "a", " A b\vc\x1cd  e\u00a0f\r\n", "x " * 9, "\u0130 \u00c4 b c d"]
    for n in (1, 3, 4):
        for text, s in zip(texts, tj.shingle_sets(texts, n), strict=True):
            words = (text or "").encode().lower().split()
            grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
            assert len(s) == len(grams) and (np.diff(s) > 0).all()


def test_texts_of_one_template_are_left_out_at_once():
    """Five thousand sets at a similarity just below the threshold: no pair is looked at; those that link are all kept."""
    import time

    rng = np.random.default_rng(3)
    template = rng.integers(0, 2**63, 180, dtype=np.uint64)
    sets = [np.unique(np.r_[template, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(5000)]
    groups, side = np.arange(5000), np.zeros(5000, np.int64)
    assert len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1])) < 0.85
    began = time.time()
    assert tj.linking(groups, sets, side, 85, 100) == [] and time.time() - began < 20
    for k in range(0, 60, 2):  # some near copies among them
        sets[k + 1] = np.unique(np.r_[sets[k][:-1], rng.integers(0, 2**63, 1, dtype=np.uint64)])
    assert {tuple(sorted(p)) for p in tj.linking(groups, sets, side, 85, 100)} == {(k, k + 1) for k in range(0, 60, 2)}


@pytest.mark.parametrize("seed", range(4))
def test_the_promising_rows_hold_all_links(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(20, 300)], rng.integers(1, 60))) for _ in range(80)]
    for k in range(0, 40):
        base = sets[rng.integers(0, 80)]
        sets.append(np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.choice(pool, rng.integers(0, 3))]))
    sets = [s for s in sets if len(s)]
    groups = rng.integers(0, 60, len(sets))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if groups[i] != groups[j] and tj.linked(sets[i], sets[j], 80, 100)]
    assert links and {k for p in links for k in p} <= set(tj.promising(groups, sets, 80, 100).tolist())
