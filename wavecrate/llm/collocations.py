"""Phrase collocations per language, counted in slots of a minimal perfect hash over Apriori-safe candidates.

1. Texts become streams of 64-bit word keys (language and word), pieces apart, written once; words are counted by Spark.
2. For 2, 3 and 4 words in turn, mappers emit the hashed phrases both of whose parts one word shorter may be frequent (a
   bitmap of fixed size says so, with false alarms only) and Spark sums them. A sum over equal hashes can only be too
   large, so no phrase of `least` occurrences is lost: the candidates are safe, but not yet proven.
3. Candidates are laid out in blocks of about KEYS keys by ranges of the key, each with a minimal perfect hash (levels of
   bits with ranks; a key's slot is the rank of its bit) that is built in a task. For each block, mappers look up the
   slot of every phrase of the stream, compare it with the key and the words stored there, and add numpy bincounts;
   their arrays are summed as a tree of fan-in FAN. That gives exact counts, and the words themselves.
4. Both parts of each cut are read from the block's count array by slot.

What a task holds is bounded: a slice of texts, a bitmap of BITMAP bits, one block's arrays, FAN arrays of CHUNK slots. A
hash is only trusted once it was checked: two words or phrases that meet in one key are noticed (whole words at word
level, word tuples at phrase level), and everything runs again with another salt. Work is a pass over the streams for
each KEYS candidates.

Defined results: null text counts as empty, null lang as `und`; repeated rows each count; ties rank by the phrase's UTF-8
bytes; texts and words of any length are taken whole; an empty table, or one without frequent phrases, gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, mix64, seeds, table, text_slices

LEAST, TOP, LONGEST, COVERED = 30, 2_000, 4, (80, 100)
KEYS, CHUNK, FAN, BITMAP = 2 << 20, 1 << 14, 32, 26  # keys of a block, slots of an array, arrays summed at once, log2 of the bitmap's bits
GAMMA, BUFFER, STRETCH = 1.5, 1 << 20, 1 << 17  # bits a key of each level of the hash; phrases that a mapper gathers before it counts them; words of a stream's row
UNKNOWN = "und"
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: space, 2: ends a piece
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def lang_seed(lang: str, salt: int) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(f"{salt}:{lang}".encode(), digest_size=8).digest(), "little"))


class Words:
    """The words of a slice of texts: where they start in the letters kept, their lengths, keys, and whether a piece begins."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: list[str], salt: int) -> None:
        low = _LOWER[data]
        kind = _KIND[low]
        inside = kind == 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        begins = at[:-1][at[:-1] < len(data)]
        fresh[begins] = inside[begins]
        starts = np.flatnonzero(fresh)
        before = np.concatenate([[0], np.cumsum(inside)])
        self.letters, self.first = low[inside], before[starts]
        self.length = np.diff(np.append(self.first, len(self.letters)))
        self.owner = np.searchsorted(at, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts]
        self.opens = np.ones(len(starts), bool)
        self.opens[1:] = (piece[1:] != piece[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.keys = np.zeros(0, U)
        if len(starts):
            own = {lang: lang_seed(lang, salt) for lang in set(langs)}
            seed = np.array([own[lang] for lang in langs], U)[self.owner]
            self.keys = np.maximum(mix64(mix64(self.sums(salt)) ^ seed), U(1))

    def sums(self, salt: int) -> np.ndarray:
        """For each word the sum of its letters' random numbers times their places' random numbers."""
        letter, place = seeds(256, salt * 2 + 11), seeds(int(self.length.max()), salt * 2 + 12) | U(1)
        values = letter[self.letters] * place[np.arange(len(self.letters)) - np.repeat(self.first, self.length)]
        return np.add.reduceat(values, self.first) + self.length.astype(U)

    def streams(self) -> list[np.ndarray]:
        """The keys, with a 0 before each piece, in stretches of whole pieces of about STRETCH keys."""
        out = np.zeros(len(self.keys) + int(self.opens.sum()), U)
        out[np.arange(len(self.keys)) + np.cumsum(self.opens)] = self.keys
        begins = np.flatnonzero(out == 0)
        cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, begins[-1] + 1, STRETCH))])
        return np.split(out, cuts[1:])

    def text(self, k: int) -> str:
        return self.letters[self.first[k] : self.first[k] + self.length[k]].tobytes().decode()


_SCAN = "keys binary, lang string, word string, key long, n long, clash boolean"


def _scan_rows(salt: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [UNKNOWN if x is None else x for x in batch.column(0).to_pylist()]
            for lo, hi, data, at in text_slices(batch.column(1), 2 << 20):
                langs = every[lo:hi]
                words = Words(data, at, langs, salt)
                if not len(words.keys):
                    continue
                keys, first, kind, count = np.unique(words.keys, return_index=True, return_inverse=True, return_counts=True)
                # Words that share a key in this slice differ in sums of other random numbers; across slices the words themselves are compared.
                check, clash = words.sums(salt + 1_000), np.zeros(len(keys), bool)
                clash[kind[check != check[first][kind]]] = True
                streams = words.streams()
                none = [None] * len(streams)
                yield pa.RecordBatch.from_pydict(
                    {
                        "keys": pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in streams] + [None] * len(keys), pa.binary()),
                        "lang": pa.array(none + [langs[words.owner[k]] for k in first.tolist()], pa.string()),
                        "word": pa.array(none + [words.text(k) for k in first.tolist()], pa.string()),
                        "key": pa.array(none + keys.view(np.int64).tolist(), pa.int64()),
                        "n": pa.array([len(x) for x in streams] + count.tolist(), pa.int64()),
                        "clash": pa.array(none + clash.tolist(), pa.bool_()),
                    }
                )

    return rows


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The streams of rows (keys, n), one at a time: packed they make small batches."""
    for raw, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
        yield np.frombuffer(pa.decompress(raw.as_buffer(), n * 8, codec="zstd"), U)


def grown(key: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The keys of phrases of `size` words from those of their first size - 1 and the last word."""
    return mix64((key ^ U(size)) * U(0x9E3779B97F4A7C15) + word)


def phrases(stream: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1 to `upto` words: their number, the key of the phrase at each place, and whether one is there."""
    key, there = stream, stream != 0
    yield 1, key, there
    for size in range(2, upto + 1):
        more = max(0, len(stream) - size + 1)
        key, there = grown(key[:more], stream[size - 1 :][:more], size), there[:more] & (stream[size - 1 :][:more] != 0)
        yield size, key, there


def marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the keys."""
    place = key >> U(64 - BITMAP)
    return (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for the upper BITMAP bits of each key: 2**BITMAP bits, whatever the number of keys."""
    place = F.shiftrightunsigned("key", 64 - BITMAP)
    bits = keys.select(F.shiftrightunsigned(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP}) & 63 as int))").alias("b"))
    got = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2**(BITMAP - 6) rows at most
    out = np.zeros(1 << BITMAP - 6, U)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(U)
    return out


def _counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate([*keys, np.zeros(0, U)]), return_counts=True)
    return pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _candidate_rows(size: int, words: np.ndarray, shorter: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for stream in unpacked(batch):
                stream = np.where(marked(words, stream), stream, U(0))  # a rare word ends a phrase like a break
                levels = list(phrases(stream, size))
                parts = levels[-2][2] & marked(shorter, levels[-2][1])
                key, there = levels[-1][1:]
                there = there & parts[: len(there)] & parts[1 : len(there) + 1] if len(there) else there
                held.append(key[there])
                n += len(held[-1])
                if n >= BUFFER:
                    yield _counted(held)
                    held, n = [], 0
        yield _counted(held)

    return rows


class Slots:
    """A minimal perfect hash with its keys: in each level a key that is alone at its place has that bit; its slot is the bit's rank."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels, base, left = [], 0, np.unique(keys)
        self.keys = np.zeros(len(left), U)
        while len(left):
            size = -(-int(len(left) * GAMMA) // 64) * 64 + 64
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone]] = 1
            bits = np.packbits(bits, bitorder="little").view(U)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((size, bits, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            left = left[~alone]
        own = self._slots(np.unique(keys))
        self.keys[own] = np.unique(keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix64(keys + U((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> U(32)) * U(size) >> U(32)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            place = self._place(keys[left], level, size)
            word, bit = bits[place >> 6], (place & 63).astype(U)
            hit = (word >> bit) & U(1) == 1
            below = np.bitwise_count(word & ((U(1) << bit) - U(1))).astype(np.int64)
            out[left[hit]] = (rank[place >> 6] + below)[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys; -1 for those that aren't stored."""
        slot = self._slots(keys)
        return np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1) if len(self.keys) else slot


def _build(group: pa.Table) -> pa.Table:
    built = Slots(group["key"].to_numpy().view(U))
    return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int64()), "size": pa.array([len(built.keys)], pa.int64()), "slots": pa.array([pickle.dumps(built)], pa.binary())})


def in_block(keys: np.ndarray, block: int, blocks: int) -> np.ndarray:
    return (keys >> U(32)) * U(blocks) >> U(32) == U(block)


def _count_rows(packed: bytes, block: int, blocks: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = pickle.loads(packed)
        n = len(slots.keys)
        count, words, clash, seen = np.zeros(n, np.int64), np.zeros((n, LONGEST), U), False, False
        for batch in batches:
            for stream in unpacked(batch):
                for size, key, there in phrases(stream, LONGEST):
                    at = np.flatnonzero(there & in_block(key, block, blocks))
                    slot = slots.find(key[at])
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    count += np.bincount(slot, minlength=n)
                    own = stream[at[:, None] + np.arange(size)]
                    new = words[slot, 0] == 0
                    words[slot[new], :size] = own[new]
                    clash |= bool((words[slot, :size] != own).any()) or bool((size < LONGEST) and words[slot, size:].any())
                    seen |= bool(len(slot))
        branch = TaskContext.get().partitionId()
        for lo in range(0, n if seen else 0, CHUNK):
            yield _array_row(lo // CHUNK, branch, count[lo : lo + CHUNK], words[lo : lo + CHUNK], clash)

    return rows


_ARRAYS = "chunk long, branch long, count binary, words binary, clash boolean"


def _array_row(chunk: int, branch: int, count: np.ndarray, words: np.ndarray, clash: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": [chunk], "branch": [branch], "count": pa.array([count.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "clash": [clash]})


def _sum(group: pa.Table) -> pa.Table:
    """The sum of arrays; word tuples of a slot must agree where both are known."""
    count, words, clash = 0, None, False
    for row in group.select(["count", "words", "clash"]).to_batches():
        for c, w, x in zip(*row.columns, strict=True):
            count = count + np.frombuffer(c.as_buffer(), np.int64)
            more = np.frombuffer(w.as_buffer(), U).reshape(-1, LONGEST)
            words = more if words is None else words
            both = (words[:, 0] != 0) & (more[:, 0] != 0)
            clash |= x.as_py() or bool((words[both] != more[both]).any())
            words = np.maximum(words, more)
    return pa.Table.from_batches([_array_row(group["chunk"][0].as_py(), group["branch"][0].as_py() // FAN, count, words, clash)])


def tree_sum(arrays: DataFrame, branches: int) -> DataFrame:
    """One row a chunk: rows of FAN branches at a time are summed."""
    while branches > 1:
        arrays = arrays.groupBy("chunk", F.expr(f"branch div {FAN}").alias("to")).applyInArrow(_sum, _ARRAYS)
        branches = -(-branches // FAN)
    return arrays


_PHRASES = "slot long, size int, n long, words array<long>, clash boolean"


def _phrase_rows(block: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, count, words, clash in zip(batch.column(0), batch.column(2), batch.column(3), batch.column(4), strict=True):
                count = np.frombuffer(count.as_buffer(), np.int64)
                words = np.frombuffer(words.as_buffer(), U).reshape(-1, LONGEST)
                at = np.flatnonzero(count)
                size = (words[at] != 0).sum(1)
                flat = words[at].view(np.int64)[np.arange(LONGEST) < size[:, None]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "slot": pa.array((at + chunk.as_py() * CHUNK + (block << 32)).astype(np.int64)), "size": pa.array(size.astype(np.int32)), "n": pa.array(count[at]),
                        "words": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat)), "clash": pa.array(np.full(len(at), clash.as_py())),
                    }
                )

    return rows


def _key(words: np.ndarray) -> np.ndarray:
    """The keys of rows of words."""
    key = words[:, 0]
    for size in range(2, words.shape[1] + 1):
        key = grown(key, words[:, size - 1], size)
    return key


_PARTS = "slot long, whole int, a long, at int, size int, part long, n long"


def _part_rows(packed: bytes, counts: np.ndarray, block: int, blocks: int):
    """For each phrase the parts (first word, number of words) that this block holds, with slot and count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = pickle.loads(packed)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            flat, start = batch.column(3).flatten().to_numpy().view(U), np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes[sizes > 1]).tolist():
                mine = np.flatnonzero(sizes == size)
                words = flat[start[mine][:, None] + np.arange(size)]
                for at in range(size):
                    for some in range(1, min(size - 1, size - at) + 1):
                        key = _key(words[:, at : at + some])
                        slot = np.where(in_block(key, block, blocks), slots.find(key), -1)
                        ok = slot >= 0
                        got = int(ok.sum())
                        yield pa.RecordBatch.from_pydict(
                            {
                                "slot": batch.column(0).take(pa.array(mine[ok])), "whole": pa.array(np.full(got, size, np.int32)), "a": batch.column(2).take(pa.array(mine[ok])), "at": pa.array(np.full(got, at, np.int32)), "size": pa.array(np.full(got, some, np.int32)),
                                "part": pa.array((slot[ok] + (block << 32)).astype(np.int64)), "n": pa.array(counts[slot[ok]]),
                            }
                        )

    return rows


class Clash(Exception):
    """Two words or phrases met in one key."""


def _counted_phrases(docs: DataFrame, least: int, salt: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """All words with counts, the phrases of 1 to LONGEST words that are frequent, and the parts of the longer ones. None if nothing is frequent."""
    spark = docs.sparkSession
    scan = materialise(docs.select("lang", "text").mapInArrow(_scan_rows(salt), _SCAN), "scan")
    stream = scan.filter("keys is not null").select("keys", "n")
    words = scan.filter("word is not null").groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("lang", "word")).alias("word"), F.max(F.struct("lang", "word")).alias("last"), F.max("clash").alias("clash"))
    words = materialise(words.select("key", "n", "word.lang", "word.word", (F.col("clash") | (F.col("word") != F.col("last"))).alias("clash")), "words")
    if not words.filter("clash").isEmpty():
        raise Clash
    often = [words.filter(F.col("n") >= least).select("key")]
    single = shorter = bitmap(often[0])
    for size in range(2, LONGEST + 1):
        found = stream.mapInArrow(_candidate_rows(size, single, shorter), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        often.append(materialise(found.filter(F.col("n") >= least).select("key"), f"candidates-{size}"))
        shorter = bitmap(often[-1])
    keys = often[0].unionByName(often[1]).unionByName(often[2]).unionByName(often[3])
    total = keys.count()
    if not total:
        return None
    blocks = -(-total // KEYS)
    block = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * blocks, 32)
    tables = materialise(keys.withColumn("block", block).groupBy("block").applyInArrow(_build, "block long, size long, slots binary"), "slots")
    packed = lambda b: bytes(tables.filter(F.col("block") == b).select("slots").first()[0])  # noqa: E731  KEYS keys, about
    held, branches = [r["block"] for r in tables.select("block").orderBy("block").collect()], stream.rdd.getNumPartitions()
    counted = {}
    for b in held:
        arrays = tree_sum(stream.mapInArrow(_count_rows(packed(b), b, blocks), _ARRAYS), branches)
        counted[b] = materialise(arrays.mapInArrow(_phrase_rows(b), _PHRASES), f"counted-{b}")
    every = reduce(DataFrame.unionByName, counted.values())
    if not every.filter("clash").isEmpty():
        raise Clash
    every = every.filter(F.col("n") >= least).drop("clash")
    parts = []
    for b, own in counted.items():
        table_, got = packed(b), own.select("slot", "n").toArrow()
        counts = np.zeros(len(pickle.loads(table_).keys), np.int64)
        counts[got["slot"].to_numpy() & 0xFFFFFFFF] = got["n"].to_numpy()
        own_parts = every.filter("size > 1").select("slot", "size", "n", "words").mapInArrow(_part_rows(table_, counts, b, blocks), _PARTS)
        parts.append(materialise(own_parts, f"parts-{b}"))
    return words, every, reduce(DataFrame.unionByName, parts)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark = docs.sparkSession
    for salt in range(8):
        try:
            counted = _counted_phrases(docs, least, salt)
            break
        except Clash:
            continue
    else:
        raise RuntimeError("word keys met under every salt")
    if counted is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    words, every, parts = counted
    longer = every.filter("size > 1").select("slot", F.col("n").alias("a"), "words")
    # Cuts: the first part starts at word 0, the rest ends at the last word.
    cut = F.when((F.col("at") == 0) & (F.col("size") < F.col("whole")), F.col("size")).when(F.col("at") + F.col("size") == F.col("whole"), F.col("at"))
    both = parts.withColumn("cut", cut).filter("cut is not null")
    both = both.groupBy("slot", "a", "cut").agg(F.max(F.when(F.col("at") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("at") > 0, F.col("n"))).alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("long")
    least_cut = both.withColumn("score", score).groupBy("slot").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # A phrase goes if a longer one around it has at least four fifths of its occurrences.
    around = parts.filter("size > 1").groupBy(F.col("part").alias("slot")).agg(F.max("a").alias("most"))
    part, whole = (F.lit(x).cast("decimal(3, 0)") for x in COVERED)
    covered = F.col("most").cast("decimal(20, 0)") * whole >= F.col("a").cast("decimal(20, 0)") * part
    kept = longer.join(around, "slot", "left").filter(~F.coalesce(covered, F.lit(False))).join(least_cut, "slot").select("slot", "a", "words", "c.l", "c.r", "c.score")
    spelt = kept.select("slot", F.posexplode("words").alias("place", "key")).join(words.select("key", "lang", "word"), "key")
    spelt = spelt.groupBy("slot").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = materialise(kept.drop("words").join(spelt, "slot"), "named")
    # The best of each language's parts, then the best of those.
    parts_of_lang = max(64, -(-named.count() // 50_000))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("slot"), F.lit(parts_of_lang))).orderBy(*best)
    first = named.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}

#: DuckDB: all phrases as text.
ORACLE = {
    "op13_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3), (4)) v(k)),
        f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
        j AS (SELECT lang, phrase, k, f AS a, ws, unnest(range(1, k)) AS cut FROM c),
        s AS (SELECT j.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score FROM j
              JOIN f x ON x.lang = j.lang AND x.phrase = array_to_string(j.ws[: j.cut], ' ') JOIN f y ON y.lang = j.lang AND y.phrase = array_to_string(j.ws[j.cut + 1 :], ' ')),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT lang, f, array_to_string(ws[i : i + z - 1], ' ') AS phrase FROM c, (VALUES (1), (2), (3)) x(i), (VALUES (2), (3)) y(z) WHERE z < k AND i + z - 1 <= k),
        b AS (SELECT lang, phrase, max(f) AS most FROM o GROUP BY ALL),
        t AS (SELECT m.* FROM m LEFT JOIN b USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * b.most >= 80::HUGEINT * m.a, false))
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) JOIN n USING (lang)
        WHERE rank <= {TOP}
    """
}
