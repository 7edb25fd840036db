"""URL filter: prefix rules, host word segmentation and multinomial naive Bayes.

Names in hosts are split into words by a unigram Viterbi search over the words that other
hosts show between dots and hyphens; two multinomial models then weigh the words of hosts
and of paths.  A host stands for the blocked class if its words have one of the seed list,
or half of its path shapes do; all other hosts stand for the allowed class, so words that
keep company with seeds are learned.  Everything is counted in hosts: a word counts once
for each host that shows it, so verdicts don't move with the number of a host's pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_if_small, cut, drop_cut

# Words of unwanted sites.
SEEDS = "adult ads bet bets bingo casino cheap clickbait gamble gambling jackpot loan lottery payday pills poker porn replica slots spam track tracker viagra warez xxx".split()
#: Known words have 2 letters to this many; longer pieces than a host label may have are not split.
LONGEST, LABEL = 20, 63
#: Host words there are beyond those seen: keeps the price of a word alike in tables of any size.
UNSEEN = 1_000_000
#: Weight of all classes' share of a word in that of one class, as a number of words.
SMOOTH = 1.0
#: A word with this share of all places is joined by a broadcast: there are at most so many.
OFTEN = 1000


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null without one).  A rule is
    ``(verdict, "host/path")``; of two equally long ones that fit the first listed wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the last set wins
        own, _, tail = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + tail))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def pieces(host: Column) -> Column:
    """What stands between the dots, hyphens and other marks of a host, without the last label."""
    name = F.regexp_replace(host, r"(^|\.)[^.]*$", "")
    return F.filter(F.split(name, "[^a-z]+"), lambda p: p != "")


def path_words(path: Column) -> Column:
    """Words of a path in lower case, each run of digits as one ``0``."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", " 0 "), "[^\\p{L}\\p{N}]+"), lambda p: p != "")


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of ``name``: a known word has its share of ``total`` and the unseen, an
    unknown one of n letters that of one occurrence dealt to all words of n letters."""
    if len(name) > LABEL:
        return [name]
    all_ = math.log(total + UNSEEN)
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    for end in range(1, len(name) + 1):
        for start in range(end):
            word = name[start:end]
            n = counts.get(word, 0) if 2 <= len(word) <= LONGEST else 0
            p = best[start][0] - all_ + (math.log(n) if n > 0 else -len(word) * math.log(26))
            if p > best[end][0] + 1e-12:
                best[end] = (p, start)
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def with_words(rows: DataFrame, words: DataFrame, places: str) -> DataFrame:
    """``rows(word, ...)`` joined to ``words(word, ..., places)``, each word once.  Words with a
    thousandth of all places, which can't be many, are joined by a broadcast and make no hot key."""
    total = words.agg(F.sum(places)).first()[0] or 0
    often = F.col(places) * OFTEN >= total
    return rows.join(F.broadcast(words.where(often)), "word").unionByName(rows.join(words.where(~often), "word"))


def segment(hosts: DataFrame) -> DataFrame:
    """``(host, words)`` for distinct hosts ``(host)``.

    A word's count is the number of hosts that show it as a piece; a piece's own host does
    not count for it, so a name known from one host only is split where its parts are known.
    """
    shown = hosts.select("host", F.explode(F.array_distinct(pieces(F.col("host")))).alias("word"))
    counts = shown.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seeds = hosts.sparkSession.createDataFrame([(w, 2) for w in SEEDS], "word string, n long")
    counts = cut(counts.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("name") - 1),
            lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("name") - i + 1)), lambda n: F.substring(F.col("name"), i, n)),
        )
    )
    names = counts.select(F.col("word").alias("name"))
    parts = names.where(F.length("name").between(2, LABEL)).select("name", F.explode(F.array_distinct(spans)).alias("word"))
    places = cut(parts.groupBy("word").agg(F.count(F.lit(1)).alias("places")).join(counts, "word"), "url-spans")
    found = with_words(parts, places, "places").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # at most 63 * 20 a name
    found = names.join(found, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = batch.column(0).to_pylist(), []
            for name, known in zip(names, batch.column(1).to_pylist(), strict=True):
                n = {k["word"]: k["n"] for k in known or []}
                n[name] = n.get(name, 0) - 1
                words.append(viterbi(name, n, total))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    split = found.select("name", "known").mapInArrow(run, "name string, words array<string>")
    split = cut(split.join(shown.groupBy(F.col("word").alias("name")).agg(F.count(F.lit(1)).alias("places")), "name"), "url-names")
    drop_cut(places)
    drop_cut(counts)
    placed = hosts.select("host", F.posexplode(pieces(F.col("host"))).alias("place", "word"))
    words = with_words(placed, split.withColumnRenamed("name", "word"), "places").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("ws"))
    words = words.select("host", F.flatten(F.transform("ws", lambda x: x["words"])).alias("words"))
    out = cut(hosts.join(words, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words")), "url-hosts")
    drop_cut(split)
    return out


def shape_words(shape: Column) -> Column:
    return F.array_distinct(F.filter(F.split(shape, " "), lambda w: w != ""))


def weigh(words: DataFrame) -> DataFrame:
    """``(word, hosts, odds)`` of ``words(host, bad, word)``, each row once: the log of how much likelier a word is
    on a blocked host than on an allowed one.  Each class mixes in the share that all hosts give
    the word, so that a rare word says little, however much larger one class is."""
    counts = words.groupBy("word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    counts = cut(counts, "url-counts")
    b, a = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    share = (F.col("b") + F.col("a")) * F.lit(SMOOTH / max(1, a + b))
    odds = F.log((F.col("b") + share) / F.lit(b + SMOOTH)) - F.log((F.col("a") + share) / F.lit(a + SMOOTH))
    out = counts.select("word", (F.col("a") + F.col("b")).alias("hosts"), (odds if a and b else F.lit(0.0)).alias("odds"))
    out.vitrina_path = counts.vitrina_path
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """All rows and columns of ``pages(url, ...)`` plus ``host, path, rule, verdict, score``.

    The verdict is that of the longest rule that fits, else ``block`` if ``score`` is above 0: the
    log of blocked to allowed hosts, plus the log-odds of the host's words, plus the mean of
    those of the path's words.  With no host of either class nothing is learned and the
    score is below 0.  Null URLs and URLs without ``://`` have empty host and path; without a host
    a page is allowed (score 0: no words, no evidence).  Pieces of more than 63 letters are one
    word.  Repeated rows are judged alike; clashing columns are replaced; an empty table gives
    an empty result.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score", "_shape")
    host, path = parse(F.col("url"))
    shaped = pages.withColumns({"host": host, "path": path}).withColumn("_shape", F.array_join(path_words(F.col("path")), " "))
    seen = cut(shaped.select("host", "_shape").where("host != ''").distinct(), "url-shapes")
    hosts = segment(seen.select("host").distinct())
    seeds = F.array(*map(F.lit, SEEDS))
    in_paths = seen.groupBy("host").agg(F.avg(F.arrays_overlap(shape_words(F.col("_shape")), seeds).cast("double")).alias("share"))
    labelled = hosts.join(in_paths, "host").select("host", "words", (F.arrays_overlap("words", seeds) | (F.col("share") >= 0.5)).alias("bad"))
    labelled = cut(labelled, "url-labels")
    drop_cut(hosts)
    own = labelled.select("host", "bad", F.explode(F.array_distinct("words")).alias("word"))
    beside = seen.select("host", F.explode(shape_words(F.col("_shape"))).alias("word")).distinct().join(labelled.select("host", "bad"), "host")
    host_words, shape_odds = weigh(own), weigh(beside)
    bad, all_ = labelled.agg(F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    prior = math.log(max(bad, 0.5) / max(all_ - bad, 0.5)) if bad else -1.0

    host_odds = with_words(own.select("host", "word"), host_words, "hosts").groupBy("host").agg(F.sum("odds").alias("_host_odds"))
    shapes = seen.select("_shape").distinct().select("_shape", F.explode(shape_words(F.col("_shape"))).alias("word"))
    path_odds = with_words(shapes, shape_odds, "hosts").groupBy("_shape").agg(F.avg("odds").alias("_path_odds"))
    host_odds, path_odds = cut(host_odds, "url-odds"), cut(path_odds, "url-odds")
    for spent in (seen, labelled, host_words, shape_odds):
        drop_cut(spent)
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = shaped.join(broadcast_if_small(host_odds, host_odds.count(), 200), "host", "left")
    out = out.join(broadcast_if_small(path_odds, path_odds.count(), 300), "_shape", "left")
    score = F.when(F.col("host") == "", 0.0).otherwise(F.lit(prior) + F.coalesce("_host_odds", F.lit(0.0)) + F.coalesce("_path_odds", F.lit(0.0)))
    out = out.withColumn("score", score).withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))})
    return out.select(*[c for c in pages.columns], "host", "path", "rule", "verdict", "score")
