import hashlib
import random

import numpy as np
import pytest

from vitrina.llm import fingerprints as fp


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def texts():
    rng = random.Random(2)
    odd = ["", "a", "ab", "a" * 19, "a" * 20, "a" * 70_000, "x" * 200_000 + "y", "\U0001f600é" * 30]
    return odd + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]


def test_spans_are_equal_wherever_they_stand():
    rng, all_ = random.Random(3), "".join(texts())
    prefixes = fp.Texts([all_]).all
    i = np.array([rng.randrange(len(all_)) for _ in range(3000)])
    j = np.minimum(i + np.array([rng.randint(0, 6) for _ in i]), len(all_))
    seen = {}
    for a, b, h in zip(i.tolist(), j.tolist(), prefixes.span(i, j).tolist(), strict=True):
        assert seen.setdefault(all_[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def test_longest_common_extensions():
    ts = texts()
    t = fp.Texts(ts)
    k, least = np.arange(len(ts) - 1), np.minimum(t.size[:-1], t.size[1:])
    assert t.all.extension(t.at[k], t.at[k + 1], least).tolist() == [common(a, b) for a, b in zip(ts, ts[1:])]
    assert t.all.extension(t.at[k + 1], t.at[k + 2], least, True).tolist() == [common(a[::-1], b[::-1]) for a, b in zip(ts, ts[1:])]


def test_sketch_keeps_the_smallest_spans():
    """The bounded search equals all spans hashed one by one by their definition."""

    def by_definition(text):
        width = min(fp.WIDTH, len(text))
        found = set()
        for i in range(len(text) - width + 1 if text else 0):
            h = 0
            for p, b in zip(fp.PRIMES, fp.BASES, strict=True):
                h = h << 31 | sum((ord(c) + 1) * pow(b, k, p) for k, c in enumerate(text[i : i + width])) % p
            x = h * 0x9E3779B97F4A7C15 % 2**64
            x ^= x >> 32
            found.add((x * 0x9E3779B97F4A7C15 % 2**64 >> 1) >> (63 - 4 * fp.SPAN))
        return sorted(found)[: fp.KEPT]

    ts = [t for t in texts() if len(t) < 100] + ["abc" * 500, "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))]
    t = fp.Texts(ts)
    value, kept = fp.sketches(t.all, t.codes, t.at)
    at = np.r_[0, np.cumsum(kept)]
    assert [value[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [by_definition(x) for x in ts]


def test_fingerprints_do_not_depend_on_company():
    ts = texts()
    prints = fp.Texts(ts).fingerprints()
    assert [fp.Texts([t]).fingerprints()[0] for t in ts[:40]] == prints[:40]
    assert len(set(prints)) == len(set(ts))


def test_likeness():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = [word() for _ in range(500)]
    text = " ".join(words)
    changed = words.copy()
    for k in (50, 150, 250, 350, 450):
        changed[k] = "zzz"
    moved = words[250:] + words[:250]
    other = " ".join(word() for _ in range(500))
    half = fp.edited(text, other)
    f = fp.Texts([text, text, " ".join(changed), " ".join(moved), other, half, text[:-5], "", "x"]).fingerprints()
    near = [fp.likeness(f[0], g) for g in f]
    assert near[0] == near[1] == 1 and near[2] > 0.8 and near[3] > 0.9 and near[4] < 0.05
    assert 0.4 < near[5] < 0.7 and near[6] > 0.9 and near[7] == 0 and near[8] == 0
    assert all(fp.likeness(a, b) == fp.likeness(b, a) and 0 <= fp.likeness(a, b) <= 1 for a in f for b in f)
    assert fp.likeness(f[7], f[7]) == 1


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_equal_their_definition(spark, parts):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 2, 5, 40, 300])))) for i in range(0, 120, 2)] + [(7, None), (9, "x" * 300_000), (11, "x" * 300_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "'n' AS n_chars", "doc_id + 1 AS other", "1 AS _role")
    got = {r.doc_id: r for r in fp.fingerprint(df).collect()}
    assert len(got) == len(rows) and set(got[7].asDict()) == {"doc_id", "text", "other", *fp.NAMES}
    ordered = sorted(((k, t or "") for k, t in rows), reverse=True)
    prints = dict(zip([k for k, _ in ordered], fp.Texts([t for _, t in ordered]).fingerprints(), strict=True))
    for (k, t), (n, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        r, e = got[k], fp.edited(t, u)
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), prints[k])
        assert r.edited_fingerprint == fp.Texts([e]).fingerprints()[0]
        assert (r.near_edited, r.near_next) == (fp.likeness(prints[k], r.edited_fingerprint), fp.likeness(prints[k], prints[n]))
        assert (r.same_start, r.same_end, r.other) == (common(t, u), common(t[::-1], u[::-1]), k + 1)


def test_null_keys_repeats_and_few_rows(spark):
    rows = [(None, "null key"), (1, "same"), (1, "same"), (1, "other text"), (2, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.fingerprint(df, keep_text=False).collect()
    assert len(got) == 5 and sum(r.near_next == 1 for r in got) == 1
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert next(r for r in got if r.doc_id is None).edited_sha256 == sha(fp.edited("null key", "two"))
    one = fp.fingerprint(df.where("doc_id = 2")).first()
    assert one.near_next == 1 and one.edited_sha256 == sha(fp.edited("two", "two"))
    assert fp.fingerprint(df.limit(0)).count() == 0
    hot = spark.range(3000).selectExpr("7L AS doc_id", "'copy' AS text").repartition(4)
    assert fp.fingerprint(hot).where("near_next = 1 AND edited_sha256 = sha2('coco', 256)").count() == 3000
