"""Token ids in binary files, compressed by a Re-Pair grammar per block.

Documents are range-partitioned and sorted by id, so that partition ``p`` holds shard ``p`` of
the global id sequence.  A shard is a row of blocks; in a block frequent neighbouring ids are
replaced by nonterminals again and again, and the rules, their expansion lengths and where
each document begins are kept beside the remaining symbols, so that one document can be
decoded alone.  Blocks are the ``payload`` of Parquet rows, which Spark's committer makes
safe against lost tasks.

Block layout, little-endian: ``RPG1``, seven uint32 (width of a symbol in bytes, first
nonterminal, rules, documents, documents with a null id (they come first), symbols, ids), the
rules (two symbols each), the expansion lengths of the rules (uint32), the document ids
(int64), the first symbol of each document and the end (uint32), the symbols.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_if_small, slices

MAGIC = b"RPG1"
_SPREAD = 0x9E3779B97F4A7C15
#: A block is closed at this many ids (a longer document is a block of its own).
BLOCK_IDS = 2_000_000
#: A pair is replaced while it occurs so often; one rule costs about as much as four symbols.
LEAST_PAIRS = 6
#: Words, and their characters, remembered by one Python worker; the memory is emptied when it is full.
KNOWN_WORDS, KNOWN_CHARS = 1_000_000, 24_000_000

# The tokenizer's own splitting, for texts of these characters only (their composed form,
# lower case and classes need no tables); other texts go through the library whole.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F)]) + "¡«»¿".encode("latin-1") + bytes(range(0xC0, 0x100))
#: Classes of characters: runs of letters and of marks are words, and each digit is one; blanks are none.
BLANK, LETTER, DIGIT, MARK = range(4)
CLASS = np.full(256, MARK, np.uint8)
CLASS[[9, 10, 13, 32]] = BLANK
CLASS[48:58] = DIGIT
CLASS[97:123] = CLASS[0xDF:0xF7] = CLASS[0xF8:] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[0xC0:0xD7] += 32
LOWER[0xD8:0xDF] += 32
#: Words of more bytes are hashed one by one.
SHORT = 40


#: Texts that tell the rules of a tokenizer apart: case, contractions, digits, marks, blanks, letters beyond ASCII.
PROBES = ["", " ", "The CAT's I'll we'd they're", "12.5% of x_y (z)--", "  two  blanks\tand\nlines ", "\u00c9t\u00e9 na\u00efve \u00dfa \u00ff", "e\u0301 \u00a1\u00bf\u00ab\u00bb", "can't'sx 'tis 1st2nd", "\u6f22\u5b57 \U0001f600"]


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def words_of(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and size of each word of lower-case Latin-1 bytes.  A single apostrophe takes the
    letters of a contraction (s, t, m, d, re, ve, ll) that follow it."""
    kind = CLASS.take(low)
    other = kind[1:] != kind[:-1]
    digit = kind == DIGIT
    begins = np.r_[True, other] | digit
    ends = np.r_[other, True] | digit
    word = kind != BLANK
    start, stop = np.flatnonzero(begins & word), np.flatnonzero(ends & word) + 1
    mark = np.flatnonzero((low[start] == 39) & (stop - start == 1))
    mark = mark[mark + 1 < len(start)]
    mark = mark[(start[mark + 1] == stop[mark]) & (kind[stop[mark]] == LETTER)]
    if len(mark):
        first = low[stop[mark]]
        second = np.where(stop[mark + 1] - start[mark + 1] > 1, low[np.minimum(stop[mark] + 1, len(low) - 1)], 0)
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = ((second == 101) & ((first == 114) | (first == 118))) | ((first == 108) & (second == 108))
        took = np.where(one, 1, np.where(two, 2, 0))
        stop[mark] += took
        start[mark + 1] += took
        full = stop > start
        start, stop = start[full], stop[full]
    return start, stop - start


def word_hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, never 0."""
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]  # long words first: each step works on a prefix
    more = len(size) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
    at, h = start[order], np.full(len(size), 0xCBF29CE484222325, np.uint64)
    for k in range(SHORT):
        m = more[k]
        if not m:
            break
        h[:m] = (h[:m] ^ low.take(at[:m] + k)) * np.uint64(_SPREAD)
        h[:m] ^= h[:m] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = h
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return out | np.uint64(1)


class Numbers:
    """Numbers of word hashes in the order in which they came, in a table of open addresses."""

    def __init__(self, most: int):
        self.bits = max(8, (2 * most).bit_length())
        self.keys, self.numbers, self.count = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for new ones."""
        out, rest, own = np.full(len(h), -1, np.int64), np.arange(len(h)), h
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            found = self.keys.take(at)
            hit = found == own
            out[rest[hit]] = self.numbers.take(at[hit])
            on = ~hit & (found != 0)
            rest, own, at = rest[on], own[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes."""
        number = self.count + np.arange(len(h), dtype=np.int32)
        self.count += len(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys.take(at) == 0
            self.keys[at[free]] = h[free]  # one of several that want a place gets it
            got = self.keys.take(at) == h
            self.numbers[at[got]] = number[got]
            h, number, at = h[~got], number[~got], (at[~got] + 1) & ((1 << self.bits) - 1)


class WordEncoder:
    """Ids by the tokenizers library, each distinct word encoded once while it is remembered."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.end = np.array([end_id], np.uint32)
        for text in PROBES:  # a tokenizer that splits or normalises otherwise is refused
            if self.ids([text])[0].tolist() != [*self.tokenizer.encode(text, add_special_tokens=False).ids, end_id]:
                raise ValueError(f"this tokenizer encodes {text!r} by rules that are not supported")

    def forget(self) -> None:
        """Empty the memory: the words' numbers, their ids on end, and where each word's begin."""
        self.known, self.chars = Numbers(KNOWN_WORDS), 0
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode new words."""
        flat, at, start = [self.flat], [self.at], len(self.flat)
        self.chars += sum(map(len, new))
        for i in range(0, len(new), 512):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new[i : i + 512])], add_special_tokens=False)[0].ids, np.uint32)
            flat.append(ids)
            at.append(start + np.flatnonzero(self.ends[ids]) + 1)
            start += len(ids)
        self.flat, self.at = np.concatenate(flat), np.concatenate(at)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text with the end id; one call handles one slice."""
        texts = [t or "" for t in texts]
        plain = [is_plain(t) for t in texts]
        own = [t for t, p in zip(texts, plain, strict=True) if p]
        low = LOWER.take(np.frombuffer("\n".join([*own, ""]).encode("latin-1"), np.uint8))
        start, size = words_of(low) if len(low) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        hashes = word_hashes(low, start, size)
        if self.chars > KNOWN_CHARS:
            self.forget()
        number = self.known.find(hashes)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, first = np.unique(hashes[unknown], return_index=True)
            if self.known.count + len(new) > KNOWN_WORDS:  # a slice has fewer words than fit
                self.forget()
                unknown = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            at = unknown[first]
            self.known.add(new)
            letters = low.tobytes().decode("latin-1")
            self.learn([letters[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)])
            number[unknown] = self.known.find(hashes[unknown])
        begin = self.at[number]
        count = self.at[number + 1] - begin
        ends = np.cumsum(count)
        ids = self.flat.take(np.arange(count.sum()) + np.repeat(begin - (ends - count), count))
        words = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in own)]))  # words before each text
        cuts = iter(np.r_[0, ends][words].tolist())
        out, a = [], next(cuts)
        for t, p in zip(texts, plain, strict=True):
            if p:
                b = next(cuts)
                out.append(np.concatenate([ids[a:b], self.end]))
                a = b
            else:
                out.append(np.concatenate([np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32), self.end]))
        return out


_encoders: dict[tuple, WordEncoder] = {}


def encoder_of(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def re_pair(ids: np.ndarray, ends: np.ndarray, base: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, remaining symbols, and where each document ends in them.

    Each round counts all pairs inside documents and replaces those near the most frequent
    count, overlapping places from the left, until no pair occurs ``LEAST_PAIRS`` times or
    the symbols of ``width`` bytes are used up.
    """
    bits, key_type = 8 * width, np.dtype(f"u{2 * width}")
    symbols, rules, made = ids.astype(key_type), [], base
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    while len(symbols) > 1:
        key = (symbols[:-1] << key_type.type(bits)) | symbols[1:]
        inside = ~last[:-1]
        ordered = np.sort(key[inside])
        if not len(ordered):
            break
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[first, len(ordered)])
        pairs = ordered[first]
        frequent = np.flatnonzero(count >= max(LEAST_PAIRS, count.max() // 4))
        room = (1 << bits) - 1 - made
        if not len(frequent) or room <= 0:
            break
        if len(frequent) > room:
            frequent = frequent[np.argsort(-count[frequent], kind="stable")[:room]]
            frequent.sort()
        chosen = pairs[frequent]
        # A table of hashed pairs leaves few places to look up.
        spread = lambda k: (k * key_type.type(_SPREAD & ((1 << 2 * bits) - 1))) >> key_type.type(2 * bits - 20)
        some = np.zeros(1 << 20, bool)
        some[spread(chosen)] = True
        places = np.flatnonzero(some[spread(key)] & inside)
        at = np.minimum(np.searchsorted(chosen, key[places]), len(chosen) - 1)
        hit = chosen[at] == key[places]
        places, at = places[hit], at[hit]
        run = np.r_[True, np.diff(places) != 1]
        start = np.maximum.accumulate(np.where(run, places, 0))
        take = (places - start) % 2 == 0
        places, at = places[take], at[take]
        symbols[places] = (made + at).astype(key_type)
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        last[places] = last[places + 1]
        symbols, last = symbols[keep], last[keep]
        rules.append(np.stack([chosen >> key_type.type(bits), chosen & key_type.type((1 << bits) - 1)], 1))
        made += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), key_type)
    return table, symbols, np.flatnonzero(last) + 1


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terminals of all rules on end, where each rule's begin, and how many they are."""
    flat, rule = rules.astype(np.int64).ravel(), np.repeat(np.arange(len(rules)), 2)
    while True:  # all rules by one level at a time
        big = flat >= base
        if not big.any():
            break
        both = rules[flat[big] - base]
        times = 1 + big
        at = (np.cumsum(times) - times)[big]
        flat, rule = np.repeat(flat, times), np.repeat(rule, times)
        flat[at], flat[at + 1] = both[:, 0], both[:, 1]
    size = np.bincount(rule, minlength=len(rules))
    return flat.astype(np.uint32), np.cumsum(size) - size, size


def pack(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """One block; null ids must come first, and no document may be without ids."""
    width = 2 if base < 60_000 else 4
    ends = np.cumsum([len(x) for x in ids])
    flat = np.concatenate(ids)
    rules, symbols, at = re_pair(flat, ends, base, width)
    size = np.ones(base + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        size[base + k] = size[a] + size[b]
    nulls = sum(i is None for i in doc_ids)
    head = struct.pack("<7I", width, base, len(rules), len(ids), nulls, len(symbols), len(flat))
    symbol = np.dtype(f"<u{width}")
    numbers = np.array([0 if i is None else i for i in doc_ids], "<i8")
    parts = rules.astype(symbol), size[base:].astype("<u4"), numbers, np.r_[0, at].astype("<u4"), symbols.astype(symbol)
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


class Block:
    """A packed block: document ids, and the ids of all documents or of one."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        width, self.base, n_rules, self.n_docs, nulls, n_symbols, self.n_ids = struct.unpack_from("<7I", data, 4)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, np.dtype(kind), n, at)
            at += out.nbytes
            return out

        self.rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        self.rule_size = take("<u4", n_rules)
        numbers = take("<i8", self.n_docs).tolist()
        self.doc_ids = [None] * nulls + numbers[nulls:]
        self.first = take("<u4", self.n_docs + 1)
        self.symbols = take(f"<u{width}", n_symbols)

    def sizes(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        size = np.where(self.symbols < self.base, 1, self.rule_size[np.maximum(self.symbols.astype(np.int64) - self.base, 0)] if len(self.rules) else 1)
        total = np.r_[0, np.cumsum(size, dtype=np.int64)]
        return np.diff(total[self.first])

    def all(self) -> np.ndarray:
        """The ids of all documents on end."""
        blob, start, size = expansions(self.rules, self.base)
        blob, start = np.r_[np.arange(self.base, dtype=np.uint32), blob], np.r_[np.arange(self.base), start + self.base]
        size = np.r_[np.ones(self.base, np.int64), size]
        own = self.symbols.astype(np.int64)
        ends = np.cumsum(size[own])
        return blob[np.arange(self.n_ids) + np.repeat(start[own] - (ends - size[own]), size[own])]

    def one(self, k: int) -> list[int]:
        """The ids of document ``k`` alone: only its own symbols are expanded."""
        out, stack = [], self.symbols[self.first[k] : self.first[k + 1]][::-1].tolist()
        while stack:
            s = stack.pop()
            if s < self.base:
                out.append(s)
            else:
                stack += [int(x) for x in self.rules[s - self.base][::-1]]
        return out


FILES = "shard int, block int, start_in_shard bigint, n_docs int, n_tokens bigint, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending key order.

    Null texts count as empty (the end id alone), null keys come first, rows of one key are
    ordered by a hash of their text.  An empty table writes no blocks.  Other columns are not
    read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer_path, end_id), TaskContext.get().partitionId()
        keys: list = []
        ids: list[np.ndarray] = []
        size = start = number = 0

        def close() -> pa.RecordBatch:
            row = [[shard], [number], [start], [len(ids)], [size], [pack(keys, ids, encoder.size)]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=[f.split()[0] for f in FILES.split(", ")])

        for batch in batches:
            all_keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for k, x in zip(all_keys[a:b], encoder.ids(texts[a:b]), strict=True):
                    if ids and size + len(x) > BLOCK_IDS:
                        yield close()
                        start, number, size, keys, ids = start + size, number + 1, 0, [], []
                    keys.append(k)
                    ids.append(x)
                    size += len(x)
        if ids:
            yield close()

    ordered.mapInArrow(run, FILES).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens, ids_crc32`` (of the ids as little-endian uint32) and, with ``ids``, ``token_ids``."""
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("shard_start"))
    # Shards number as many as the writer's partitions, each of which was one task.
    placed = files.join(broadcast_if_small(starts, int(spark.conf.get("spark.sql.shuffle.partitions")), 32), "shard")
    placed = placed.select((F.col("shard_start") + F.col("start_in_shard")).alias("at"), "payload")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", token_ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py())
                sizes, flat = block.sizes(), block.all().astype("<u4")
                ends = np.cumsum(sizes)
                begin = ends - sizes
                own = [flat[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(block.doc_ids, pa.int64()), pa.array(at + begin), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    return placed.mapInArrow(run, schema)
