"""Personal data by patterns and bootstrapped contexts (DataFrame functions only).

The base patterns find seeds: emails, addresses, cards and phone numbers; long hexadecimal
keys are seeds too, but no spans by themselves.  What stands beside a seed are its lexical
patterns: the word before it, the two words before it, or the word after it, each with the
marks between.  Identifiers (runs with a digit or an at sign that no base pattern takes)
in the same places are a pattern's other instances.

Patterns and instances are scored in turn over their graph.  A pattern's score is the share
of all its places in the corpus that accepted instances fill, and it needs three different ones; an
instance's is that at least one of its patterns is right.  An accepted instance counts in all
its other places, so each round may rate new patterns, until none is added.  Identifiers in
the places of patterns of high confidence join the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_if_small, cut, drop_cut, let, running

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of all spans: a key is one only where a pattern finds it.
ALL_KINDS = [*KINDS, "secret"]
# The base patterns, with possessive repeats and starts at the ends of runs: the same
# matches without backtracking over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
IDENTIFIER = r"(?<![\p{L}\p{N}._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]{5,}+"
KEY = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
#: Different instances a pattern needs, the least scores of patterns and instances, and the most rounds.
LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE, ROUNDS = 3, 0.6, 0.6, 5

_FAR = 2**31 - 1
SPAN = "struct<s:int,e:int,m:string,l:string,r:string>"
# A word, the marks beside it, and the places of the patterns in a text in lower case: what the first
# group takes.  Marks end before a letter, a digit or the plus sign of a number.
_W, _M = r"\p{L}{2,36}", r"[^\p{L}\p{N}]{1,4}"
CONTEXTS = {
    "<": (rf"(?<![\p{{L}}\p{{N}}])({_W}{_M})$", rf"(?<![\p{{L}}\p{{N}}])(?=({_W}{_M}?)(?=[\p{{L}}\p{{N}}+]))\p{{L}}++"),
    "<<": (rf"(?<![\p{{L}}\p{{N}}])({_W}{_M}{_W}{_M})$", rf"(?<![\p{{L}}\p{{N}}])(?=({_W}{_M}{_W}{_M}?)(?=[\p{{L}}\p{{N}}+]))\p{{L}}++"),
    ">": (rf"^({_M}{_W})(?![\p{{L}}\p{{N}}])", rf"(?<=[\p{{L}}\p{{N}}])({_M}{_W})(?![\p{{L}}\p{{N}}])"),
}


def places(text: Column, pattern: str) -> Column:
    """All matches from left to right: array of ``struct(s, e, m, l, r)``: code points, end exclusive, the
    match, and what is close on its left and right up to the matches beside it."""

    def part(x: Column) -> Column:
        return F.struct(F.length(x["g"]).alias("g"), F.length(x["f"]).alias("f"), x["f"].alias("m"), F.right(x["g"], F.lit(90)).alias("l"), F.left(x["h"], F.lit(45)).alias("r"))

    def placed(at: Column) -> Column:
        s = at["before"] + at["x"]["g"]
        return F.struct(s.alias("s"), (s + at["x"]["f"]).alias("e"), *[at["x"][f].alias(f) for f in ("m", "l", "r")])

    def zipped(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("f"), F.slice(gaps, 2, F.size(found)).alias("h"))
        return F.transform(running(F.transform(pairs, part), lambda x: x["g"] + x["f"], lambda a, b: a + b, 0), placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others`` (``struct(s, e, ...)``), in order: one look at the farthest end of others
    that start before, one at the nearest start of those after."""

    def entry(own: bool):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (F.struct(*[x[f].alias(f) for f in ("s", "e", "m", "l", "r")]) if own else F.lit(None)).cast(SPAN).alias("own"))

    every = F.array_sort(F.concat(F.transform(others, entry(False)), F.transform(spans, entry(True))))
    ends = running(every, lambda x: F.when(x["own"].isNull(), x["e"]).otherwise(0), F.greatest, 0)
    free = F.transform(ends, lambda x: F.struct(x["x"].alias("x"), (x["before"] <= x["x"]["s"]).alias("free")))
    starts = running(F.reverse(free), lambda x: F.when(x["x"]["own"].isNull(), x["x"]["s"]).otherwise(_FAR), F.least, _FAR)
    good = F.filter(F.reverse(starts), lambda x: x["x"]["x"]["own"].isNotNull() & x["x"]["free"] & (x["before"] >= x["x"]["x"]["e"]))
    return F.transform(good, lambda x: x["x"]["x"]["own"])


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (q.try_cast("int") <= 255)))
    if kind == "card":
        return let(F.regexp_replace(match, "[ -]", ""), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: valid(kind, x["m"])


def _numbered(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), *[x[f].alias(f) for f in ("s", "e", "m", "l", "r")])


def _is(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by kind as listed, then start: ``struct(k, s, e, m, l, r)``."""
    out = []
    for k, kind in enumerate(KINDS):
        gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
        own = F.transform(F.filter(places(text, PATTERNS[kind]), _valid(kind)), _numbered(k))
        out.append(F.when(gate, own).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,m:string,l:string,r:string>>")))
    return F.concat(*out)


def _named(k: str):
    """A pattern's text with its kind before it; null if it is empty."""
    return lambda c: F.when(c != "", F.concat(F.lit(k), c))


def beside(x: Column) -> Column:
    """The patterns that an occurrence is in."""
    at = {"<": F.lower(x["l"]), "<<": F.lower(x["l"]), ">": F.lower(x["r"])}
    found = [let(F.regexp_extract(at[k], own, 1), _named(k)) for k, (own, _) in CONTEXTS.items()]
    return F.array_compact(F.array(*found))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, by kind as listed, then start."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def discover(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """New spans ``(doc_id, h, k, s, e)``: identifiers of ``occurrences(doc_id, h, k, base, s, e, inst, ctx)``
    in the places of patterns of high confidence.  ``k`` is the kind of a seed, null for
    others; ``base`` marks what is a span already."""
    each = occurrences.select("doc_id", "h", "k", "base", "s", "e", "inst", F.explode("ctx").alias("ctx"))
    edges = cut(each.groupBy("ctx", "inst").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")), "pii-edges")
    # Patterns that could ever be rated: of enough instances, and enough of all their places.
    some = edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).where(F.col("d") >= LEAST_SEEDS).select("ctx", "n")
    some = cut(some, "pii-patterns")
    low = F.lower("text")
    words = F.concat(*[F.transform(F.regexp_extract_all(low, F.lit(places_), F.lit(1)), _named(k)) for k, (_, places_) in CONTEXTS.items()])
    seen = docs.where(F.col("text") != "").select(F.explode(words).alias("ctx"))
    seen = seen.join(broadcast_if_small(some.select("ctx"), some.count(), 150), "ctx", "left_semi").groupBy("ctx").agg(F.count(F.lit(1)).alias("seen"))
    rateable = some.join(seen, "ctx", "left").select("ctx", F.greatest("n", F.coalesce("seen", F.lit(0))).alias("total"), "n").where(F.col("n") >= LEAST_PATTERN * F.col("total"))
    rateable = cut(rateable.select("ctx", "total"), "pii-totals")
    drop_cut(some)
    many = rateable.count()
    near = cut(edges.join(broadcast_if_small(rateable, many, 160), "ctx"), "pii-near")
    drop_cut(edges)
    first = near.groupBy("inst").agg(F.max("k").alias("k")).select("inst", "k", F.col("k").isNotNull().cast("double").alias("score"))
    scores, rated, known = cut(first, "pii-instances"), None, -1
    for _ in range(ROUNDS):
        accepted = scores.where(F.col("score") >= LEAST_INSTANCE).count()
        if accepted == known:  # the last round added nothing
            break
        known = accepted
        good = F.col("score") >= LEAST_INSTANCE
        by_kind = near.drop("k").join(scores, "inst").groupBy("ctx", "k").agg(F.sum(F.col("n") * F.col("score")).alias("w"), F.count_if(good).alias("d"), F.max("total").alias("total"))
        by_ctx = by_kind.groupBy("ctx").agg(F.least(F.sum("w") / F.max("total"), F.lit(0.99)).alias("p"), F.sum("d").alias("d"), F.max_by("k", F.struct("w", -F.col("k"))).alias("kind"))
        spent = rated
        rated = cut(by_ctx.where((F.col("p") >= LEAST_PATTERN) & (F.col("d") >= LEAST_SEEDS)).select("ctx", "p", "kind"), "pii-rated")
        right = near.select("ctx", "inst").join(broadcast_if_small(rated, many, 170), "ctx").groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("found"), F.max_by("kind", F.struct("p", "ctx")).alias("kind"))
        then = scores.join(right, "inst", "left").select("inst", F.coalesce("k", "kind").alias("k"), F.greatest("score", F.coalesce("found", F.lit(0.0))).alias("score"))
        before, scores = scores, cut(then, "pii-instances")
        drop_cut(before)
        if spent is not None:
            drop_cut(spent)
    good = scores.where(F.col("score") >= LEAST_INSTANCE).select("inst", F.col("k").alias("own"))
    new = each.where("not base").select("doc_id", "h", "s", "e", "inst", "ctx").join(broadcast_if_small(rated, many, 170), "ctx").join(good, "inst")
    out = cut(new.groupBy("doc_id", "h", "s", "e").agg(F.max_by(F.coalesce("own", "kind"), F.struct("p", "ctx")).alias("k")).select("doc_id", "h", "k", "s", "e"), "pii-new")
    for spent in (near, rateable, scores, rated):
        drop_cut(spent)
    return out


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` (without the text if not ``keep_text``) plus ``n_email, n_ip,
    n_card, n_phone`` (base spans), ``n_found`` (spans of discovered identifiers), ``base_sha256``,
    ``spans`` (all, as ``kind:start:end``) and ``pii`` (all, as structs of kind number and places).

    Null texts count as empty: no spans.  Whole texts are read.  Rows that agree in ``doc_id``
    and text have equal results; null ids are ids.  Clashing columns are replaced; an empty
    table gives an empty result.
    """
    added = [*(f"n_{k}" for k in KINDS), "n_found", "base_sha256", "spans", "pii"]
    docs = docs.drop(*added, "_text", "_found", "_spans", "_ids", "_h")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({"_text": text, "_h": F.xxhash64(text)})
    some = F.col("_text").rlike("[0-9@]")
    spans_type = "array<struct<k:int,s:int,e:int,m:string,l:string,r:string>>"
    rows = rows.withColumn("_spans", F.when(some, base_spans(F.col("_text"))).otherwise(F.array().cast(spans_type)))

    def free(spans: Column) -> Column:
        return apart(places(F.col("_text"), IDENTIFIER), spans)

    def occurrence(x: Column, k: Column, base: bool) -> Column:
        return F.struct(k.alias("k"), F.lit(base).alias("base"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["m"]).alias("inst"), beside(x).alias("ctx"))

    key = lambda x: F.when(F.lower(x["m"]).rlike(KEY), ALL_KINDS.index("secret"))
    seen = F.concat(
        F.transform("_spans", lambda x: occurrence(x, x["k"], True)),
        F.transform(let(F.col("_spans"), free), lambda x: occurrence(x, key(x), False)),
    )
    none = F.array().cast("array<struct<k:int,base:boolean,s:int,e:int,inst:string,ctx:array<string>>>")
    rows = rows.withColumn("_ids", F.when(some, F.filter(seen, lambda x: F.size(x["ctx"]) > 0)).otherwise(none))
    spans = F.transform("_spans", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    kept = [c for c in docs.columns if keep_text or c != "text"]
    key = [] if "doc_id" in kept else [F.lit(None).cast("bigint").alias("doc_id")]
    base = cut(rows.select(*kept, *key, "_h", spans.alias("_spans"), "_ids"), "pii-base")
    occurrences = base.where(F.size("_ids") > 0).select("doc_id", F.col("_h").alias("h"), F.explode("_ids").alias("i")).select("doc_id", "h", "i.*")
    new = discover(docs.select(text.alias("text")), occurrences)
    found_ = cut(new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("k", "s", "e")).alias("_found")), "pii-found")  # of one text
    drop_cut(new)
    a, b = base.alias("a"), broadcast_if_small(found_, found_.count(), 200).alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._h") == F.col("b.h")), "left")
    found = F.coalesce(F.col("_found"), F.array().cast("array<struct<k:int,s:int,e:int>>"))
    every = F.array_sort(F.concat("_spans", found))
    counts = [F.size(F.filter("_spans", _is(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(*[F.col(f"a.{c}") for c in kept], *counts, F.size(found).cast("bigint").alias("n_found"), F.sha2(written(F.col("_spans")), 256).alias("base_sha256"), every.alias("pii")).withColumn("spans", written(F.col("pii")))


def redact(found: DataFrame) -> DataFrame:
    """Rows of :func:`find` with each span of the text replaced by its kind in brackets (of
    overlapping spans the first covers the part they share)."""
    names = F.array(*[F.lit(f"[{k}]") for k in ALL_KINDS])
    order = F.array_sort(F.transform("pii", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def piece(x: Column) -> Column:
        """What stands before a span, and its mark if it is the first where it starts."""
        gap = F.substring(F.col("text"), x["before"] + 1, F.greatest(x["x"]["s"] - x["before"], F.lit(0)))
        return F.concat(gap, F.when(x["x"]["s"] >= x["before"], F.element_at(names, x["x"]["k"] + 1)).otherwise(""))

    pieces = F.array_join(F.transform(running(order, lambda x: x["e"], F.greatest, 0), piece), "")
    rest = F.substring(F.col("text"), F.array_max(F.transform("pii", lambda x: x["e"])) + 1, F.length("text"))
    return found.withColumn("text", F.when(F.size("pii") > 0, F.concat(pieces, rest)).otherwise(F.col("text")))
