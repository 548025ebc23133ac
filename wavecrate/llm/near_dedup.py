"""Near-duplicate detection by BagMinHash over multisets of five-word shingles.

Words are runs of letters and digits (A-Z in lower case, every byte above ASCII a letter). A text's shingles with their
counts are its bag. BagMinHash runs, for each shingle, Poisson processes over its discretised weight: weight [0, 1), then
[1, 2), [2, 4), [4, 8) and so on, each a process of its own whose points fall on a random register; points beyond the
weight are thinned away. A register keeps its earliest point, so two bags agree in it with the probability of their
weighted Jaccard similarity. Points later than a text's latest register are never made.

BANDS bands of ROWS registers propose candidates. Texts with equal bags are one class from the start and send one
member on. In each bucket, every member is verified against the smallest; connected components follow. Buckets that
still hold several components are then searched whole: their members come together in blocks of BLOCK (a larger
bucket as pairs of blocks), overlaps of all members are counted by matrix products, and a block returns a spanning
forest of its links, never its pairs. So no link within a bucket is lost and no bucket is capped.
Verification compares the whole multisets: shared count over united count of at least SIMILARITY.

Defined results: null and empty texts and texts without words are classes of their own; texts of fewer than five words
have one shingle, all their words; rows are told apart by doc_id and text (a hash of it), so those that share a doc_id
are in one class only if their bags are equal or linked, and class_key (the hash of the text of the class's smallest
row) tells classes with the same smallest doc_id apart; rows that repeat doc_id and text are kept or dropped
together; rows without a doc_id stay, with a null class; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, mix64, rows_of, seeds, table, text_key, text_slices

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
SLICE, BLOCK, COLUMNS = 2 << 20, 2_048, 4_096
NODE = "struct<doc_id:bigint,h:bigint>"  # a row: its doc_id and the hash of its text
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE, STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below n or more."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, SLICE + 1024)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts by text: number of the text, 48-bit shingle hash, and count, in ascending order."""
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        good = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(good & np.concatenate([[True], ~good[:-1]]) | good & edge[:-1]) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(good & (np.concatenate([~good[1:], [True]]) | edge[1:])) + 1 if len(data) else starts
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((_LOW[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        word = mix64((prefix[ends] - prefix[starts]) * down[starts])
        owner = np.searchsorted(at, starts, "right") - 1
        n = len(at) - 1
        per = np.bincount(owner, minlength=n)
        full = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            full = full * STEP + word[k : k + len(full)]
        inside = owner[: len(full)] == owner[WORDS - 1 : WORDS - 1 + len(full)]
        text, value = [owner[: len(full)][inside]], [mix64(full[inside])]
        first = np.cumsum(per) - per
        for k in range(1, WORDS):
            short = np.flatnonzero(per == k)
            if len(short):
                own = np.full(len(short), k, np.uint64)
                for j in range(k):
                    own = own * STEP + word[first[short] + j]
                text.append(short)
                value.append(mix64(own))
        key = np.concatenate(text).astype(np.uint64) << np.uint64(48) | np.concatenate(value) >> np.uint64(16)
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The registers of n texts: times of the earliest accepted points."""
    sig = np.full((n, registers), np.inf)
    flat, latest = sig.reshape(-1), np.full(n, np.inf)
    levels, level, low = [], 0, 0
    while len(count) and low < count.max():
        mine = np.flatnonzero(count > low)
        levels.append((mine, np.full(len(mine), level)))
        low, level = max(1, 2 * low), level + 1
    if not levels:
        return sig
    which, level = (np.concatenate(x) for x in zip(*levels, strict=True))
    below = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, below)
    with np.errstate(over="ignore"):
        state = mix64(shingle[which] * GOLDEN + (level.astype(np.uint64) + np.uint64(1)) * STEP)
        owner, weight, rate, time = owner[which], count[which], registers * width, np.zeros(len(which))
        while len(state):
            state = state + GOLDEN
            draw = mix64(state)
            time = time - np.log(((draw >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / rate
            alive = time < latest[owner]
            if not alive.all():
                owner, weight, rate, time, state, draw, below, width = (x[alive] for x in (owner, weight, rate, time, state, draw, below, width))
            place = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
            spot = below + width * ((mix64(draw ^ STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = np.flatnonzero(spot < weight)
            np.minimum.at(flat, owner[hit] * registers + place[hit].astype(np.int64), time[hit])
            latest = sig.max(1)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    with np.errstate(over="ignore"):
        bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
        key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            key = mix64(key * STEP + bits[:, :, k])
    return key.view(np.int64)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = seeds(2, 5)
    for batch in batches:
        for lo, hi, data, at in text_slices(batch.column(1), SLICE):
            n = hi - lo
            owner, shingle, count = bags(data, at)
            keys = bands(signatures(owner, shingle, count, n, BANDS * ROWS))
            # A bag's fingerprint: sums of its mixed members, so equal bags agree whatever the order of their shingles.
            prints = []
            with np.errstate(over="ignore"):
                for s in salt:
                    member = mix64(mix64(shingle ^ s) + count.astype(np.uint64) * STEP)
                    total = np.concatenate([[np.uint64(0)], np.cumsum(member, dtype=np.uint64)])
                    at_text = np.searchsorted(owner, np.arange(n + 1))
                    prints.append((total[at_text[1:]] - total[at_text[:-1]]).view(np.int64))
            size = np.bincount(owner, count, n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(size), *map(pa.array, prints), lists], ["doc_id", "h", "size", "f1", "f2", "bands"])


def similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, text_a, text_b) whose bags are similar enough."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            some = batch.slice(lo, 128)
            found = []
            for name in ("text_a", "text_b"):
                column = some.column(some.schema.get_field_index(name))
                parts = [(first, bags(data, at)) for first, _, data, at in text_slices(column, SLICE)]
                owner, shingle, count = (np.concatenate([p[k] + (first if k == 0 else np.uint64(0) if k == 1 else 0) for first, p in parts]) for k in range(3))
                found.append((owner.astype(np.uint64) << np.uint64(48) | shingle, count, np.bincount(owner, count, some.num_rows)))
            (key_a, n_a, all_a), (key_b, n_b, all_b) = found
            both, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
            shared = np.bincount((both >> np.uint64(48)).astype(np.int64), np.minimum(n_a[i], n_b[j]), some.num_rows)
            keep = np.flatnonzero(shared >= SIMILARITY * (all_a + all_b - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([some.column(some.schema.get_field_index(c)).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def forest(group: pa.Table) -> pa.Table:
    """Links (a, b) that join the similar members of one block (id, text): each to the smallest it reaches."""
    group = group.combine_chunks()
    ids = group["id"].combine_chunks()
    order = np.lexsort((ids.field("h").to_numpy(), ids.field("doc_id").to_numpy()))
    group, ids, n = group.take(order), ids.take(pa.array(order)), group.num_rows
    column = group["text"].combine_chunks() if isinstance(group["text"], pa.ChunkedArray) else group["text"]
    parts = [(first, bags(data, at)) for first, _, data, at in text_slices(column, SLICE)]
    owner, shingle, count = (np.concatenate([p[k] + (first if k == 0 else np.uint64(0) if k == 1 else 0) for first, p in parts]) for k in range(3))
    total = np.bincount(owner, count, n)
    # A shingle that stands c times is c elements, so that shared counts are shared elements.
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        element = np.repeat(shingle, count) * GOLDEN + turn.astype(np.uint64) * STEP
    owner = np.repeat(owner, count)
    _, element, uses = np.unique(element, return_inverse=True, return_counts=True)
    common = uses > 1
    number = np.cumsum(common) - 1
    keep = common[element]
    element, owner = number[element[keep]], owner[keep]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(element, (lo, lo + COLUMNS))
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[i:j], element[i:j] - lo] = 1
        shared += x @ x.T
    linked = shared >= SIMILARITY * (total[:, None] + total[None, :] - shared) - 1e-6
    root = np.arange(n)
    while True:  # the least number that each reaches
        least = np.where(linked, root[None, :], n).min(1)
        least = np.minimum(root, least)
        if (least == root).all():
            break
        root = least
    far = np.flatnonzero(root != np.arange(n))
    return pa.table({"a": ids.take(pa.array(far)), "b": ids.take(pa.array(root[far]))})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by their texts (id, text)."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return materialise(rows.mapInArrow(similar_rows, f"a {NODE}, b {NODE}"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node) of every node of the edges (a, b), by alternating large and small stars."""
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        # Large star: each node links its larger neighbours to its smallest.
        both = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node links its smaller neighbours to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = materialise(small, "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_key, class_size, kept."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("h"))
    sketch = materialise(ids.filter("doc_id is not null").mapInArrow(_sketch_rows, "doc_id long, h long, size long, f1 long, f2 long, bands array<bigint>"), "sketch")
    sketch = sketch.withColumn("node", F.struct("doc_id", "h"))
    some = sketch.filter("size > 0")
    same = materialise(some.groupBy("f1", "f2").agg(F.min("node").alias("rep")), "same")
    first = some.join(same.withColumn("node", F.col("rep")), ["node", "f1", "f2"]).select("rep", "bands").dropDuplicates(["rep"])
    rows = first.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = materialise(rows.join(shared, ["band", "key"]), "buckets")
    pairs = materialise(rows.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    # Texts of candidates move once; the same kind of join at every size.
    asked = rows.select(F.col("rep").alias("id")).distinct()
    texts = materialise(ids.select(F.struct("doc_id", "h").alias("id"), "text").join(asked.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = verified(pairs, texts)
    roots = components(links)
    named = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    state = rows.join(named("rep"), "rep", "left").join(named("least"), "least", "left")
    apart = F.coalesce("rep_root", "rep") != F.coalesce("least_root", "least")
    members = F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2")
    open_ = state.groupBy("band", "key").agg(F.max(apart).alias("open"), F.count("*").alias("n"), *members).filter("open")
    # Buckets of several bands often have the same members; one of them is enough.
    open_ = materialise(open_.dropDuplicates(["n", "m1", "m2"]).select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    if not open_.isEmpty():
        blocks = rows.select("band", "key", "rep").join(open_, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("rep").alias("id"))
        found = blocks.join(texts.hint("merge"), "id").groupBy("band", "key", "i", "j").applyInArrow(forest, f"a {NODE}, b {NODE}")
        roots = components(links.union(materialise(found, "forest")))

    classes = same.join(roots, same["rep"] == roots["node"], "left").select("f1", "f2", F.coalesce("root", "rep").alias("class"))
    told = sketch.join(classes.hint("merge"), ["f1", "f2"], "left").select("node", F.when(F.col("size") > 0, F.col("class")).otherwise(F.col("node")).alias("class"))
    told = materialise(told, "classes")
    sizes = told.groupBy("class").agg(F.count("*").alias("class_size"))
    out = told.join(sizes.hint("merge"), "class").select("node.doc_id", F.col("class.doc_id").alias("class_id"), F.col("class.h").alias("class_key"), "class_size", (F.col("node") == F.col("class")).alias("kept"))
    nameless = ids.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.col("h").alias("class_key"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; all columns. Rows without a doc_id all stay."""
    stay = near_groups(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("class_key").alias("key"))
    return rows_of(docs.filter("doc_id is not null"), stay, text_key()).unionByName(docs.filter("doc_id is null"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("class_key")


QUERIES = {"op8_near_dedup": op8_near_dedup}
