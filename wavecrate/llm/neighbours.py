"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances on a sphere: candidates are scaled by the largest norm and get one more component that
fills them to length 1, queries are scaled to length 1. Each of TABLES tables hashes a vector by Gaussian (2-stable)
projections cut into slots of WIDTH; their number grows with the logarithm of the table, so that a bucket holds about
FILL vectors at every size. A query visits the buckets around its own in the order of their estimated chance to hold a
neighbour: given the cosine c of a 20th neighbour (that nine tenths of SAMPLE queries exceed, measured against all
rows), its projection is normal around c times the query's with the variance that 1 - c*c leaves the axis. Visits end when the chances add up to
the share that TABLES tables need for TARGET. Candidates are sifted by matrix products; those within rounding of the
best are scored again on the original vectors, component by component in order, so a score and its ties don't depend on
where a row fell.

The work per query is the number of visited buckets times FILL. It is a small share of the table where neighbours are
near (clusters), and nearly all of it where they aren't: among directions without structure no bucket can be left out.

Equal vectors are one class (its TOP + 1 smallest ids are all that an answer can need), so a vector that fills a third
of the table is indexed once. Large buckets are split into blocks of BLOCK classes, and every block is visited: no
candidate of a visited bucket is dropped. Blocks are gathered in parts of up to PART_BYTES of vectors. A part is sent
once, before the queries that visit it, which stream past it ASKED at a time: neither is copied for the other's sake,
and a query gets TOP + 1 classes from a part, however many buckets and tables it visits there.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor those whose
length isn't that of the row with the smallest id; null ids take no part; rows that repeat an id and vector count once;
ties go to the smaller vec_id; a query without other vectors returns nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, table

TOP, EVERY = 20, 20
TABLES, WIDTH, TARGET = 3, 2.0, 0.985
FILL, SLOTS, MOST_HASHES = 128, 2.7, 15  # vectors of a bucket; slots that a projection fills in effect; a code has 4 bits each
SAMPLE, BLOCK, PART_BYTES, ASKED, REACH = 256, 4_096, 64 << 20, 256, 2
ROUNDING = 1e-9  # of the largest product; far over what summing in another order can change


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = v.filter(fine & F.exists("vector", lambda x: x != 0)).distinct()
    size = v.agg(F.min_by(F.size("vector"), "vec_id")).first()[0]
    return v.filter(F.size("vector") == F.lit(size or 0))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: cid (smallest id), vector and its `keep` smallest ids."""
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.withColumn("k", order).filter(F.col("k") <= keep)
    return few.groupBy("vector").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26, error under 2e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.where(z > 0, 1 - tail / 2, tail / 2)


def hashes(n: int) -> int:
    """Projections of a table of n vectors: buckets of FILL vectors at every size."""
    return int(np.clip(round(np.log(max(1, n / FILL)) / np.log(SLOTS)), 1, MOST_HASHES))


class Hashing:
    """The tables' projections for vectors of one length, the largest norm and the typical neighbour's cosine."""

    def __init__(self, size: int, norm: float, cosine: float, n: int) -> None:
        rng = np.random.default_rng(20)
        self.norm, self.cosine, self.k = norm, cosine, hashes(n)
        self.axes = rng.normal(size=(TABLES, size + 1, self.k))
        self.shift = rng.uniform(0, WIDTH, (TABLES, self.k))

    def filled(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def code(self, slots: np.ndarray) -> np.ndarray:
        """Slot numbers as one integer, four bits each."""
        code = np.zeros(slots.shape[:-1], np.int64)
        for k in range(self.k):
            code = code << 4 | np.clip(slots[..., k], -8, 7).astype(np.int64) + 8
        return code

    def buckets(self, x: np.ndarray) -> list[np.ndarray]:
        x = self.filled(x)
        return [self.code(np.floor((x @ self.axes[t] + self.shift[t]) / WIDTH)) for t in range(TABLES)]

    def likeliest(self, chance: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """Steps from the query's own slots, likeliest first, whose chances reach `enough`; and those chances.

        chance: of each projection's slots. Steps are built projection by projection; those that are too unlikely to
        matter are left out, fewer of them with each try, until enough of the whole is kept.
        """
        least = 1e-4
        while True:
            steps, each = np.zeros((1, 0), np.int8), np.ones(1)
            for k in range(self.k):
                each = (each[:, None] * chance[k][None, :]).ravel()
                steps = np.column_stack([np.repeat(steps, chance.shape[1], axis=0), np.tile(np.arange(chance.shape[1], dtype=np.int8), len(steps))])
                keep = each >= least * each.max()
                steps, each = steps[keep], each[keep]
            if each.sum() >= min(enough, chance.sum(1).prod() * 0.999) or least < 1e-12:
                order = np.argsort(-each, kind="stable")
                return steps[order], each[order]
            least /= 100

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """The buckets of each table that a query visits, likeliest first."""
        q = np.append(q / np.linalg.norm(q), 0.0)
        enough, spread = 1 - (1 - TARGET) ** (1 / TABLES), np.sqrt(max(1e-9, 1 - self.cosine**2) / max(1, len(q) - 1)) / WIDTH
        out = []
        for t in range(TABLES):
            along = q @ self.axes[t]
            center = (self.cosine * along + self.shift[t]) / WIDTH
            sigma = spread * np.sqrt((self.axes[t] ** 2).sum(0) - along**2)[:, None]  # what of each axis is square to the query
            slot = np.floor(center)
            edges = slot[:, None] + np.arange(-REACH, REACH + 2)
            steps, each = self.likeliest(np.diff(_phi((edges - center[:, None]) / sigma), axis=1), enough)
            visits = int(np.searchsorted(np.cumsum(each), enough)) + 1
            out.append(np.unique(self.code(slot + steps[:visits] - REACH)))
        return out


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q with the rows of x, added component by component from the first."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _sample_cosines(x: np.ndarray, ids: np.ndarray, norm: float):
    """For each sampled query the cosines, on the sphere, of its TOP nearest in each batch, itself aside."""
    queries = x / np.linalg.norm(x, axis=1)[:, None] / norm

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                cosines = matrix(some.column(1)) @ queries.T
                cosines[some.column(0).to_numpy()[:, None] == ids] = -2
                best = -np.partition(-cosines, min(TOP, len(cosines)) - 1, axis=0)[:TOP]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(ids), dtype=np.int32), len(best))), pa.array(best.ravel())], ["query", "cosine"])

    return rows


def fit(distinct: DataFrame) -> Hashing | None:
    """Measures the largest norm over all rows, and the cosine of a typical TOP-th neighbour of SAMPLE queries among all rows."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    n, largest = distinct.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    asked = distinct.select("cid", "vector").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()  # SAMPLE rows at most
    x, ids = np.array([r.vector for r in asked]), np.array([r.cid for r in asked])
    near = distinct.select("cid", "vector").mapInArrow(_sample_cosines(x, ids, largest), "query int, cosine double").filter("cosine > -2")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine")))).filter(F.col("k") <= TOP)
    typical = near.groupBy("query").agg(F.min("cosine").alias("c")).agg(F.expr("percentile(c, 0.1)")).first()[0]  # one number
    return Hashing(x.shape[1], largest, float(np.clip(typical or 0.0, 0, 0.999)), n)


def _index_rows(hashing: Hashing):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, codes in enumerate(hashing.buckets(matrix(batch.column(1)))):
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(codes), t, np.int32)), pa.array(codes)], ["cid", "vector", "tbl", "bucket"])

    return rows


def _probe_rows(hashing: Hashing):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for t, codes in enumerate(hashing.probes(matrix(batch.column(1).slice(k, 1))[0])):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.zeros(len(codes), int) + k)), pa.array(np.full(len(codes), t, np.int32)), pa.array(codes)], ["qid", "tbl", "bucket"])

    return rows


def _kept(scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` largest scores and of all within rounding of the last of them."""
    if len(scores) <= keep:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - keep)[len(scores) - keep]
    return np.flatnonzero(scores >= last - ROUNDING * max(1e-300, float(np.abs(scores).max())))


class Part:
    """The vectors of one part by spot."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        self.rows_of: dict[int, np.ndarray] = {}
        if not rows:
            return
        data = pa.Table.from_batches(rows)
        self.ids, self.x = data["id"].to_numpy(), matrix(data["vector"])
        spot = data["spots"].combine_chunks().flatten().to_numpy()  # one each
        order = np.argsort(spot, kind="stable")
        spots, first = np.unique(spot[order], return_index=True)
        self.rows_of = dict(zip(spots.tolist(), np.split(order, first[1:]), strict=True))

    def best(self, asked: pa.RecordBatch, keep: int) -> pa.RecordBatch:
        """The best `keep` classes of each query of the batch among the spots it visits."""
        qids, q = asked.column("id").to_numpy(), matrix(asked.column("vector"))
        visits: dict[int, list[int]] = {}
        for k, own in enumerate(asked.column("spots").to_pylist()):
            for spot in own:
                visits.setdefault(spot, []).append(k)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
        for spot, askers in visits.items():
            mine = self.rows_of.get(spot)
            if mine is None:  # a block that got none of its bucket's classes
                continue
            for k, row in zip(askers, q[askers] @ self.x[mine].T, strict=True):
                best = _kept(row, keep)
                found[k].append((row[best], mine[best]))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k, parts in enumerate(found):
            if not parts:
                continue
            rough, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            _, once = np.unique(self.ids[at], return_index=True)  # a class may come from several tables
            at = at[once][_kept(rough[once], keep)]
            exact = in_order(q[k], self.x[at])
            order = np.lexsort((self.ids[at], -exact))[:keep]
            out.append((np.full(len(order), qids[k]), self.ids[at][order], exact[order]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["qid", "cid", "score"])


def _score(keep: int):
    """Over rows in the order of part and asks: each part's vectors, then its queries in slices of ASKED."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, part = None, [], None
        for batch in batches:
            kind = np.stack([batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
            edges = np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if kind[0, lo] != number:
                    number, gathered, part = kind[0, lo], [], None
                if not kind[1, lo]:
                    gathered.append(batch.slice(lo, hi - lo))
                    continue
                if part is None:
                    part, gathered = Part(gathered), []
                for at in range(lo, hi, ASKED):
                    yield part.best(batch.slice(at, min(ASKED, hi - at)), keep)

    return rows


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: the `top` nearest found to each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    distinct = materialise(classes(rows, top + 1), "classes")
    hashing = fit(distinct)
    if hashing is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asks = rows.filter(F.col("vec_id") % every == 0).join(distinct.select("vector", "cid"), "vector").select("vec_id", F.col("cid").alias("qid"))
    asks = materialise(asks, "queries")
    index = distinct.select("cid", "vector").mapInArrow(_index_rows(hashing), "cid long, vector array<double>, tbl int, bucket long")
    index = materialise(index, "index")
    filled = index.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Parts of PART_BYTES at most, fewer vectors where cores would idle; the number changes no answer.
    held = distinct.count() * TABLES
    parts = max(-(-held * 8 * hashing.axes.shape[1] // PART_BYTES), min(-(-held // BLOCK), 2 * spark.sparkContext.defaultParallelism))
    spot = F.xxhash64("tbl", "bucket", "block")
    part = F.pmod(F.col("spot"), F.lit(parts)).alias("part")
    data = index.join(filled, ["tbl", "bucket"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("spot", spot)
    data = data.select(part, F.lit(False).alias("asks"), F.col("cid").alias("id"), "vector", F.array("spot").alias("spots"))
    sought = distinct.join(asks.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vector")
    probes = sought.mapInArrow(_probe_rows(hashing), "qid long, tbl int, bucket long").join(filled, ["tbl", "bucket"])
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("spot", spot)
    # A query goes to a part once, with all the spots it visits there.
    visits = materialise(probes.select("qid", part, "spot").groupBy("part", "qid").agg(F.collect_set("spot").alias("spots")), "visits")
    asked = visits.join(sought.withColumnRenamed("cid", "qid"), "qid").select("part", F.lit(True).alias("asks"), F.col("qid").alias("id"), "vector", "spots")
    found = data.unionByName(asked).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "asks").mapInArrow(_score(top + 1), "qid long, cid long, score double")
    found = found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= top + 1)
    ids = found.join(distinct.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= top + 1)
    answers = asks.withColumnRenamed("vec_id", "query_id").join(ids.drop("k"), "qid").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_neighbours": op5_neighbours}
