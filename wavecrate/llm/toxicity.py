"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

A document is a bag of words; its score is that of its most toxic word. Words are folded to 26 letters (accents off,
digits read as the letters they imitate), marks inside a word are skipped and single letters that stand apart are
joined, so `i.d.i.o.t`, `1d1ot` and `i d i o t` meet `idiot`; what stands between marks is a word as well, so `so.idiot`
does too. The kernel of two words is the number of common
subsequences of LENGTH letters (word borders count as letters) within SPAN positions, each weighted DECAY for every
position it spans in either word, over a norm that depends on the words' lengths; inserted letters only cost weight.

Training is multiple-instance: each toxic training document names the word that marks it best (first by document
frequencies, then by the machine itself), clean documents give negatives. Landmarks are training words, the Nyström map
whitens the kernel between them, and the linear machine on it collapses into one weight per subsequence, so scoring
gathers from one table whatever the number of landmarks. The threshold also sees the toxic documents with a letter
inserted into what marks them. Training takes at most SAMPLE labelled documents of each class (lowest id hash first, not
held out; one row of a doc_id; labels of absent documents don't count), each whole; scoring reads every text whole, long
words in overlapping windows.

Defined results: null texts, empty texts and texts without letters get the lowest score; without labels of both
classes every score is 0; repeated rows get equal results; an empty table gives an empty result; several labels of one
document count as toxic if any is; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import hash_limit, held_out, materialise, mix64, table, text_slices

LENGTH, SPAN, DECAY = 4, 7, 0.6
SAMPLE, LANDMARKS, ROUNDS, MARKS, GAPPED = 1_500, 384, 3, 300, 10
CLEAR_SHARE, CLEAR_ODDS = 0.02, 2.5  # share of the toxic documents, and log odds, of a clear mark
WIDTH, STRIDE = 16, 8  # letters of a window of a long word
START, STOP = 30, 31

_CODE = np.full(256, 255, np.uint8)  # 255: skipped, 0: white space
for _i in range(26):
    _CODE[65 + _i] = _CODE[97 + _i] = _i + 1
for _b in (9, 10, 11, 12, 13, 32):
    _CODE[_b] = 0
for _digit, _letter in zip("013457", "oieast", strict=True):  # digits that imitate letters
    _CODE[ord(_digit)] = ord(_letter) - 96
# Second bytes of the Latin letters U+00C0 to U+00FF, without accents; - for the signs among them.
_PLAIN = "aaaaaaaceeeeiiiidnooooo-ouuuuytsaaaaaaaceeeeiiiidnooooo-ouuuuyty"
_LATIN = np.array([255 if c == "-" else ord(c) - 96 for c in _PLAIN], np.uint8)
#: Positions of the subsequences that start at a position.
OFFSETS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]
NORM = {n: float(np.sqrt(sum(max(0, n - o[-1]) * DECAY ** (2 * (o[-1] + 1)) for o in OFFSETS))) or 1.0 for n in range(1, WIDTH + 3)}


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all words as rows of WIDTH letter codes (0 after the end), their lengths and their text's number, by text.

    Words are read twice: with the marks inside them skipped, and split at marks.
    """
    code = _CODE[data]
    code[data >= 128] = 255
    tail = np.flatnonzero((data[1:] & 0xC0) == 0x80) + 1
    if len(tail):
        before = data[tail - 1]
        code[tail] = np.where(before == 0xC3, _LATIN[data[tail] & 63], 27 + data[tail] % 3)
        # U+0080 to U+00BF and U+2000 to U+207F hold signs; their spaces are white space.
        code[tail[before == 0xC2]] = 255
        code[tail[(before == 0xC2) & (data[tail] == 0xA0)]] = 0
        signs = tail[(before == 0xE2) & (data[tail] <= 0x81)]
        code[signs] = 255
        last = signs[signs + 1 < len(data)] + 1
        code[last] = np.where((data[last - 1] == 0x80) & (data[last] <= 0x8A), 0, 255)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = [_windows(code, owner, code != 255), _windows(np.where(code == 255, 0, code).astype(np.uint8), owner, slice(None))]
    rows, length, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    return rows[order], length[order], owner[order]


def _windows(code: np.ndarray, owner: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, owner = code[keep], owner[keep]
    letter = code > 0
    fresh = np.ones(len(code), bool)
    fresh[1:] = ~letter[:-1] | (owner[1:] != owner[:-1])
    fresh = fresh[letter]
    code, owner = code[letter], owner[letter]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(code)))
    # Single letters that stand next to one another are one word.
    single = size == 1
    joined = np.zeros(len(first), bool)
    joined[1:] = single[1:] & single[:-1] & (owner[first[1:]] == owner[first[:-1]])
    first = first[~joined]
    size = np.diff(np.append(first, len(code)))
    more = np.maximum(0, -(-(size - WIDTH) // STRIDE)) + 1
    start = np.repeat(first, more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    length = np.minimum(WIDTH, np.repeat(first + size, more) - start)
    padded = np.concatenate([code, np.zeros(WIDTH, np.uint8)])
    rows = padded[start[:, None] + np.arange(WIDTH)]
    rows[np.arange(WIDTH) >= length[:, None]] = 0
    return rows, length, owner[start] if len(start) else np.zeros(0, np.int64)


def features(rows: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, float]]:
    """Subsequence numbers, a column for each place, and their weights, for words of one length n."""
    full = np.zeros((len(rows), n + 2), np.int32)
    full[:, 1:-1] = rows[:, :n]
    full[:, 0], full[:, -1] = START, STOP
    for first in range(n + 2):
        for o in OFFSETS:
            if first + o[-1] < n + 2:
                number = full[:, first]
                for step in o[1:]:
                    number = number << 5 | full[:, first + step]
                yield number, DECAY ** (o[-1] + 1) / NORM[n + 2]


def word_scores(rows: np.ndarray, length: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word."""
    out = np.full(len(rows), bias)
    for n in np.unique(length).tolist():
        mine = np.flatnonzero(length == n)
        for number, weight in features(rows[mine], n):
            out[mine] += weight * weights[number]
    return out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one row of each kind and the kind of every row, by a 64-bit hash of the letters."""
    with np.errstate(over="ignore"):
        halves = np.ascontiguousarray(rows).view(np.uint64)
        key = mix64(halves[:, 0]) + mix64(halves[:, 1] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    return first, kind


def variants(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Copies of the words of 4 to WIDTH - 1 letters with one letter inserted at each inner place, letters taken in turn."""
    out = []
    for row, n in zip(rows, length.tolist(), strict=True):
        for k in range(1, n if 4 <= n < WIDTH else 0):
            letter = (int(row.sum()) * 7 + k * 11) % 26 + 1
            out.append(np.concatenate([row[:k], [letter], row[k:-1]]))
    return np.array(out, np.uint8).reshape(-1, WIDTH)


class SubsequenceMachine:
    """One weight per subsequence, a bias, and the logistic curve that turns a document's value into its score."""

    def __init__(self, bags: list[tuple[bool, list[bytes]]]) -> None:
        names = sorted({w for _, bag in bags for w in bag})
        number = {w: k for k, w in enumerate(names)}
        rows = np.frombuffer(b"".join(names), np.uint8).reshape(-1, WIDTH)
        length = (rows > 0).sum(1)
        toxic = np.array([t for t, _ in bags])
        own = [np.array([number[w] for w in bag], np.int64) for _, bag in bags]
        in_toxic, in_clean = (np.bincount(np.concatenate([o for o, t in zip(own, toxic, strict=True) if t == k] or [np.zeros(0, int)]), minlength=len(names)) for k in (True, False))
        value = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic).sum() + 1))
        order = mix64(np.arange(len(names), dtype=np.uint64))
        # A document may hold several insults; all that mark toxic documents clearly are positives, not only its first.
        clear = np.flatnonzero((in_toxic >= max(3, CLEAR_SHARE * toxic.sum())) & (value >= CLEAR_ODDS))
        self.weights, self.bias = np.zeros(1 << 5 * LENGTH, np.float32), 0.0
        hard = np.zeros(0, np.int64)
        for _ in range(ROUNDS):
            marks, times = np.unique([o[value[o].argmax()] for o, t in zip(own, toxic, strict=True) if t and len(o)], return_counts=True)
            marks, times = np.union1d(marks, clear), np.bincount(marks, times, len(names))[np.union1d(marks, clear)] + in_toxic[np.union1d(marks, clear)]
            often = np.argsort(-in_clean, kind="stable")[:1_000]
            some = np.argsort(order)[:3_000]
            clean = np.unique(np.concatenate([often, some[in_clean[some] > 0], hard]))
            clean = clean[(in_clean[clean] > 0) & ~np.isin(clean, marks)]
            top = marks[np.argsort(-times, kind="stable")]
            # Copies of the commonest marks with a letter inserted show the machine what gaps to bear.
            spread = np.concatenate([rows, variants(rows[top[:MARKS]], length[top[:MARKS]])])
            added = np.arange(len(rows), len(spread))
            chosen = np.concatenate([marks, added, clean])
            y = np.where(np.arange(len(chosen)) < len(marks) + len(added), 1.0, -1.0)
            landmarks = np.concatenate([top[: LANDMARKS * 2 // 3], clean[np.argsort(-value[clean], kind="stable")][: LANDMARKS // 3]])
            self._fit(spread, (spread > 0).sum(1), chosen, y, landmarks)
            value = word_scores(rows, length, self.weights, self.bias)
            worst = [o[value[o].argmax()] for o, t in zip(own, toxic, strict=True) if not t and len(o)]
            hard = np.unique(np.concatenate([hard, worst]).astype(np.int64))
        best = np.array([value[o].max() if len(o) else self.bias for o in own])
        marked = [o[value[o].argmax()] for o, t in zip(own, toxic, strict=True) if t and len(o)]
        inserted = variants(rows[marked], length[marked])
        gapped = word_scores(inserted, (inserted > 0).sum(1), self.weights, self.bias) if len(inserted) else np.zeros(0)
        # A tenth as many as there are toxic documents: enough to lower the threshold where clean documents leave room.
        gapped = gapped[np.argsort(mix64(np.arange(len(gapped), dtype=np.uint64)))[: int(toxic.sum()) // GAPPED]]
        self.slope, self.shift = self._curve(np.concatenate([best, gapped]), np.concatenate([toxic, np.ones(len(gapped), bool)]))

    def _fit(self, rows: np.ndarray, length: np.ndarray, chosen: np.ndarray, y: np.ndarray, landmarks: np.ndarray) -> None:
        numbers, columns = [], []
        for k, w in enumerate(landmarks.tolist()):
            for number, weight in features(rows[w : w + 1], int(length[w])):
                numbers.append(int(number[0]))
                columns.append((k, weight))
        present, inverse = np.unique(numbers, return_inverse=True)
        own = np.zeros((len(present) + 1, len(landmarks)), np.float32)  # the last row: subsequences of no landmark
        np.add.at(own, (inverse, [k for k, _ in columns]), [w for _, w in columns])
        place = np.full(1 << 5 * LENGTH, len(present), np.int32)
        place[present] = np.arange(len(present))

        def kernel(which: np.ndarray) -> np.ndarray:
            out = np.zeros((len(which), len(landmarks)), np.float32)
            for n in np.unique(length[which]).tolist():
                mine = np.flatnonzero(length[which] == n)
                for number, weight in features(rows[which[mine]], n):
                    out[mine] += weight * own[place[number]]
            return out

        spectrum, basis = np.linalg.eigh(kernel(landmarks).astype(np.float64))
        good = spectrum > 1e-6 * spectrum.max()
        whiten = basis[:, good] / np.sqrt(spectrum[good])
        w, self.bias = svm(kernel(chosen) @ whiten, y)
        beta = whiten @ w
        self.weights[:] = 0
        self.weights[present] = own[:-1] @ beta

    @staticmethod
    def _curve(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
        """Logistic curve around the best threshold, a third of the way from the clean values to the toxic ones."""
        order = np.argsort(value, kind="stable")
        v, t = value[order], toxic[order]
        wrong = np.concatenate([[(~t).sum()], (~t).sum() + np.cumsum(np.where(t, 1, -1))])
        k = np.flatnonzero(wrong == wrong.min())
        k = int(k[len(k) // 2])
        low, high = v[max(0, k - 1)], v[min(len(v) - 1, k)]
        return 4.0 / max(float(np.std(v)), 1e-6), float(low + (high - low) / 3)

    def document_scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, length, owner = words(data, at)
        best = np.full(len(at) - 1, -np.inf)
        if len(rows):
            first, kind = distinct(rows)
            value = word_scores(rows[first], length[first], self.weights, self.bias)[kind]
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best[owner[begins]] = np.maximum.reduceat(value, begins)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.slope * (best - self.shift)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared-hinge machine; both classes weigh the same. Weights and bias."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    each = cost * np.where(y > 0, 1.0, max(0.2, (y > 0).sum() / max(1, (y < 0).sum())))
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = np.einsum("ij,ij->i", x, x) + 1 / (2 * each)
    order = np.argsort(mix64(np.arange(len(x), dtype=np.uint64) + np.uint64(3)))
    for _ in range(rounds):
        most = 0.0
        for i in order:
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * each[i])
            if alpha[i] == 0 and slope >= 0:
                continue
            step = max(-alpha[i], -slope / diagonal[i])
            alpha[i] += step
            w += step * y[i] * x[i]
            most = max(most, abs(slope))
        if most < 1e-2:
            break
    return w[:-1], float(w[-1])


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_pylist()
        for lo, hi, data, at in text_slices(batch.column(0), 1 << 20):
            rows, _, owner = words(data, at)
            bags = [[] for _ in range(hi - lo)]
            if len(rows):
                first = np.unique(owner, return_index=True)[1].tolist() + [len(owner)]
                for a, b in zip(first, first[1:], strict=False):
                    bags[owner[a]] = sorted({r.tobytes() for r in rows[a:b]}, key=lambda w: (zlib.crc32(w), w))
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic[lo:hi], pa.bool_()), "words": pa.array(bags, pa.list_(pa.binary()))})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SubsequenceMachine | None:
    """Learns from labelled documents that aren't held out; None without documents of both classes."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")  # labels of documents that aren't here teach nothing
    # Few hashes of each class are low enough to be looked at, so no class is sorted in one task.
    low = {r["toxic"]: hash_limit(r["count"], sample) for r in known.groupBy("toxic").count().collect()}
    known = known.filter(F.xxhash64("doc_id") <= F.when(F.col("toxic"), low.get(True, 0)).otherwise(low.get(False, 0)))
    known = known.withColumn("k", F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("k") <= sample)
    texts = docs.select("doc_id", "text").join(known.hint("broadcast"), "doc_id")  # at most 2 * sample rows
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # one row of a doc_id
    bags = texts.select("text", "toxic").mapInArrow(_bag_rows, "toxic boolean, words array<binary>")
    got = sorted((r.toxic, [bytes(w) for w in r.words]) for r in bags.collect())  # bounded by the sample
    if len({t for t, _ in got}) < 2 or not any(t and bag for t, bag in got):
        return None
    return SubsequenceMachine(got)


def _score_rows(model: SubsequenceMachine | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch.column(1), 2 << 20):
                score = model.document_scores(data, at) if model else np.zeros(hi - lo)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "score": pa.array(score)})

    return rows


def score(docs: DataFrame, model: SubsequenceMachine | None) -> DataFrame:
    """doc_id and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score_rows(model), f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
