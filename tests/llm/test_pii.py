import hashlib
import random
import re
from collections import Counter, defaultdict

import regex
from vitrina.llm import pii

# The base patterns as given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        worth = [int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, p in BASE.items() for m in re.finditer(p, text or "") if good(kind, m[0])]


def same(rows):
    for r in rows:
        want = brute(r.text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.text[:200], want, r.spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))
        assert r.n_found or r.spans == joined


ODD = ["a@b.c_d@e.f.g", "x@y", "a@b..c", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.0255", "12345.1.2.3", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111",
       "+1 (017) 555-7713", "+1", "+12345678", "+1 2 3 4 5 6 7 8 ) ", "+123 +4567890123", "é😀 +49 30 1234567 é a@b.co", "1" * 30000, "a" * 30000 + "@" + "b." * 9000 + "c", "0-" * 20000, "+1" + " " * 20000, "a.b" * 5000,
       "79927398713 4242424242424242 5", "a@b.c@d.e", "%@-.-", "1.2.3.4@5.6", "Version 2.0.", ""]


def test_base_spans_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[0]), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS h")
    out = pii.find(df).collect()
    assert len(out) == len(rows)
    same(out)
    assert pii.find(df.limit(0)).count() == 0


def test_base_spans_on_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    out = pii.find(docs).collect()
    assert len(out) == docs.count() and sum(r.n_email + r.n_card + r.n_ip + r.n_phone for r in out) > 5
    same(out)


def gaps(text, pattern, fits=lambda m: True):
    """(start, end, match, left, right) of all matches, the sides up to the matches beside."""
    found = list(regex.finditer(pattern, text))
    ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)]
    return [(m.start(), m.end(), m[0], text[ends[i] : m.start()][-90:], text[m.end() : starts[i + 1]][:45]) for i, m in enumerate(found) if fits(m[0])]


def contexts(left, right):
    """The word before, the two words before, the word after, with the marks between."""
    mark, word, alone = r"[^\p{L}\p{N}]{1,4}", r"\p{L}{2,36}", r"(?<![\p{L}\p{N}])"
    one, two = regex.search(f"{alone}{word}{mark}$", left.lower()), regex.search(f"{alone}{word}{mark}{word}{mark}$", left.lower())
    after = regex.match(f"{mark}{word}(?![\\p{{L}}\\p{{N}}])", right.lower())
    return [k + m[0] for k, m in (("<", one), ("<<", two), (">", after)) if m]


def all_places(text):
    """Every place of every pattern in a text, found by trying each word."""
    text, out = text.lower(), Counter()
    ends = r"(?=[\p{L}\p{N}+])"
    for m in regex.finditer(r"\p{L}+", text):
        if m.start() and regex.match(r"[\p{L}\p{N}]", text[m.start() - 1]):
            continue
        one = regex.compile(r"\p{L}{2,36}[^\p{L}\p{N}]{1,4}?" + ends).match(text, m.start())
        two = regex.compile(r"\p{L}{2,36}[^\p{L}\p{N}]{1,4}\p{L}{2,36}[^\p{L}\p{N}]{1,4}?" + ends).match(text, m.start())
        out.update(k + m[0] for k, m in (("<", one), ("<<", two)) if m)
    out.update(">" + m[0] for m in regex.finditer(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]{1,4}\p{L}{2,36}(?![\p{L}\p{N}])", text))
    return out


def replica(rows):
    """The discovery by its definition: {(row, kind, start, end)}."""
    seen, filled, kinds, others = Counter(), defaultdict(Counter), {}, []
    for row, (_, text) in enumerate(rows):
        text = text or ""
        seen += all_places(text)
        taken = []
        for kind, p in BASE.items():
            for s, e, m, left, right in gaps(text, p, lambda m, kind=kind: good(kind, m)):
                taken.append((s, e))
                if c := contexts(left, right):
                    kinds[m.lower()] = max(pii.ALL_KINDS.index(kind), kinds.get(m.lower(), 0))
                for x in c:
                    filled[x][m.lower()] += 1
        for s, e, m, left, right in gaps(text, pii.IDENTIFIER):
            if any(a < e and s < b for a, b in taken):
                continue
            c = contexts(left, right)
            if c and re.fullmatch("[0-9a-f]{32,}", m.lower()) and re.search("[0-9]", m) and re.search("[a-f]", m.lower()):
                kinds.setdefault(m.lower(), 4)
            for x in c:
                filled[x][m.lower()] += 1
            others.append((row, s, e, m.lower(), c))
    score = Counter(dict.fromkeys(kinds, 1.0))
    for _ in range(pii.ROUNDS):
        rated = {}
        for x, n in filled.items():
            p = sum(k * score[i] for i, k in n.items()) / max(seen[x], sum(n.values()))
            if sum(score[i] >= pii.LEAST_INSTANCE for i in n) >= 3 and p >= pii.LEAST_PATTERN:
                by = Counter()
                for i, k in n.items():
                    by[kinds.get(i)] += k * score[i]
                rated[x] = min(p, 0.99), max((k for k in by if k is not None), key=lambda k: (by[k], -k))
        before = sum(v >= pii.LEAST_INSTANCE for v in score.values())
        for i in {i for x in rated for i in filled[x]}:
            mine = [(rated[x][0], x) for x in rated if i in filled[x]]
            wrong = 1.0
            for p, _ in mine:
                wrong *= 1 - p
            score[i] = max(score[i], 1 - wrong)
            kinds.setdefault(i, rated[max(mine)[1]][1])
        if sum(v >= pii.LEAST_INSTANCE for v in score.values()) == before:
            break
    return {(row, kinds[i], s, e) for row, s, e, i, c in others if score[i] >= pii.LEAST_INSTANCE and set(c) & set(rated)}


PROSE = "the and of to in salt pepper river stone garden and the of".split()


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(PROSE) for _ in range(n))
    ident = [f"acc-{rng.randrange(10**6):06d}" for _ in range(25)]
    rows = []
    for i in range(220):
        kind = rng.randrange(7)
        middle = [
            lambda: f"Mail: user{i}@host{i % 9}.org,", lambda: f"account no: {rng.choice(ident)}", lambda: f"card 4{rng.randrange(10**8):08d}", lambda: f'token = "{rng.getrandbits(160):040x}"',
            lambda: f"Mail: u{i}x@host{i % 7}.org,", lambda: f"mail: {rng.choice(ident)}", lambda: f"{rng.choice(ident)} (ledger) {words(1)} mail {words(2)}",
        ][kind]()
        rows.append((i, f"{words(rng.randrange(1, 9))} {middle} {words(rng.randrange(0, 6))}"))
    return rows


def test_discovery_equals_its_definition(spark):
    total = 0
    for seed in (1, 2):
        rows = [*corpus(seed), (500, None), (501, ""), (502, 'x token = "secret-77"'), (503, "sha " + "a1" * 20), (504, "account no: new-4711, " + " ".join(PROSE))]
        rows += [rows[0], rows[3]]
        out = pii.find(spark.createDataFrame([(r, t) for r, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
        got = {(r.doc_id, x.k, x.s, x.e) for r in out for x in r.pii} - {(row, pii.KINDS.index(k), s, e) for row, (_, t) in enumerate(rows) for k, s, e in brute(t)}
        assert got == replica(rows)
        total += len(got)
        by = {r.doc_id: r for r in out}
        n = len(rows) - 7
        # A key's context finds a key of another shape; a hash in prose is none; accounts are found by
        # what follows mail addresses first, and their own context by them in the next round.
        assert by[n + 2].n_found == 1 and ",secret:" in "," + by[n + 2].spans and by[n + 3].n_found == 0 and by[n + 4].n_found == 1
    assert total > 100


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.co 10.0.{i % 250}.7 x{i}y2z" for i in range(15000))
    began = __import__("time").time()
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 15000 == r.n_ip and __import__("time").time() - began < 90


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please write. Mail: user{i}@host{i}.org and the rest of it, the 99887-{i}") for i in range(12)]
    rows += [(100, "Mail: user77(at)x, mail: user_77@intranet soon"), (101, "the user_77@intranet or the 12345-678"), (102, "no mail here")]
    rows += [(200, "mail: user_77@intranet"), (200, "mail: user_77@intranet"), (201, None), *[(300 + i, "pepper salt and pepper and salt and pepper") for i in range(9)]]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in out}
    at = rows[12][1].index("user_77@")
    assert by[100].n_found == 2 and by[100].spans == f"email:6:12,email:{at}:{at + 16}"
    assert by[101].n_found == 0 and by[102].n_found == 0 and by[0].n_found == 0
    assert by[200].n_found == 1 and len(out) == len(rows)
    texts = {r.doc_id: r.text for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert texts[0] == "Please write. Mail: [email] and the rest of it, the 99887-0" and texts[201] is None
    assert texts[200] == "mail: [email]" and texts[102] == rows[14][1]


def test_redaction_covers_overlaps(spark):
    text = "é +1 1.2.3.4 555 x 4111111111111111 y"
    r = pii.redact(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    left = r.text
    assert not re.search("[0-9]{2}", left) and left.startswith("é [phone]") and left.endswith(" y")


def test_keys_in_either_case_have_one_kind(spark):
    rng = random.Random(21)
    keys = [f"{rng.getrandbits(160) | 1 << 159:040x}" for _ in range(6)]
    rows = [(i, f'salt pepper token = "{k}" of stone') for i, k in enumerate(keys)] + [(10, f'river token = "{keys[0].upper()}" of garden'), (11, 'garden token = "AB-12-cd" of salt')]
    rows += [(20 + i, "salt and pepper of the river garden") for i in range(6)]
    by = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (*range(6), 10):
        start = rows[i if i < 10 else 6][1].index('"') + 1
        assert by[i].spans == f"secret:{start}:{start + 40}" and by[i].n_found == 1
    assert by[11].spans.startswith("secret:") and by[20].spans == ""
