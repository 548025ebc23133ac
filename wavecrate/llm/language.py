"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family picks the family; inside it, one-versus-one machines between
all pairs of its languages vote. Features are relative frequencies of hashed letter trigrams (bytes of the UTF-8 text,
ASCII letters in lower case, runs of other ASCII characters as one space).

Training uses only text and non-null lang of documents that are not held out and have a letter: of every language the
SAMPLE documents whose id and text hash lowest, each as a whole and rows that repeat both once (ROWS // languages of each,
if there are more than ROWS / SAMPLE languages). Those bounds hold for training alone; scoring reads every text whole. The
weights grow with the pairs of languages of a family.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing could be learned; ties of
votes go to the larger sum of margins, then to the first language in order; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import hash_limit, held_out, materialise, mix64, rows_of, table, text_key, text_slices

BITS, SAMPLE, ROWS = 14, 300, 38_400
UNKNOWN = "und"

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("an", "ast", "ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "ro", "sc"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indic": ("bn", "gu", "hi", "kn", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd", "gv", "kw"),
    "baltic": ("lt", "lv"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LOWER = np.where(_LETTERS, np.arange(256), 32).astype(np.uint8)
_LOWER[65:91] += 32
_ANY_LETTER = regex.compile(r"\p{L}")


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after another, and the offset of each text's first. Each text stands between spaces."""
    n = len(at) - 1
    text = np.full(len(data) + 2 * n, 32, np.uint8)
    # Each text is moved to its place by two per text before it, plus one.
    place = np.arange(len(data)) + np.repeat(np.arange(n) * 2 + 1, np.diff(at))
    text[place] = _LOWER[data]
    owner = np.repeat(np.arange(n), np.diff(at) + 2)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (owner[1:] != owner[:-1])
    text, owner = text[keep].astype(np.uint32), owner[keep]
    gram = text[:-2] << np.uint32(16) | text[1:-1] << np.uint32(8) | text[2:]
    inside = owner[:-2] == owner[2:]
    gram = (gram[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return gram.astype(np.int64), np.searchsorted(owner[:-2][inside], np.arange(n + 1))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, _, data, at in text_slices(batch.column(0), 1 << 20):
            grams, first = trigrams(data, at)
            for k in range(len(at) - 1):
                own, counts = np.unique(grams[first[k] : first[k + 1]], return_counts=True)
                if len(own) and _LETTERS[data[at[k] : at[k + 1]]].any():
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang[lo + k]]), "gram": pa.array([own.astype(np.int32)], pa.list_(pa.int32())), "n": pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))})


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Dual coordinate descent for the squared-hinge support vector machine over sparse rows; the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    diagonal = np.array([v @ v + 1 for _, v in rows]) + 1 / (2 * cost)
    order = np.argsort(mix64(np.arange(len(rows), dtype=np.uint64) + np.uint64(7)))
    for _ in range(rounds):
        most = 0.0
        for i in order:
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1 + alpha[i] / (2 * cost)
            if alpha[i] == 0 and slope >= 0:
                continue
            before = alpha[i]
            alpha[i] = max(0.0, before - slope / diagonal[i])
            step = (alpha[i] - before) * y[i]
            w[at] += step * v
            w[-1] += step
            most = max(most, abs(slope))
        if most < 1e-2:
            break
    return w


class Hierarchy:
    """Families, languages and the weights of all machines, one column each."""

    def __init__(self, rows: list[tuple[str, list[int], list[int]]]) -> None:
        langs = sorted({r[0] for r in rows})
        self.langs = langs
        family = {c: FAMILY_OF.get(c.lower(), "other") for c in langs}
        self.families = sorted(set(family.values()))
        self.members = [[langs.index(c) for c in langs if family[c] == f] for f in self.families]
        size = 1 << BITS
        x = [(np.array(grams), np.sqrt(np.array(counts, float) / sum(counts))) for _, grams, counts in rows]
        y = np.array([langs.index(r[0]) for r in rows])
        group = np.array([self.families.index(family[r[0]]) for r in rows])
        self.pairs = [(a, b) for m in self.members for i, a in enumerate(m) for b in m[i + 1 :]]
        machines = [linear_svm(x, np.where(group == f, 1.0, -1.0), size) for f in range(len(self.families))] if len(self.families) > 1 else []
        machines += [linear_svm([x[k] for k in both], np.where(y[both] == a, 1.0, -1.0), size) for a, b in self.pairs for both in [np.flatnonzero((y == a) | (y == b))]]
        self.weights = np.array(machines, np.float32).reshape(len(machines), (1 << BITS) + 1)

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row of margins."""
        n, f = len(margins), len(self.families) if len(self.families) > 1 else 0
        sure = 1 / (1 + np.exp(-4 * margins)) if margins.size else np.zeros((n, 0))
        group = margins[:, :f].argmax(1) if f else np.zeros(n, int)
        score = sure[np.arange(n), group] if f else np.ones(n)
        lang = np.zeros(n, int)
        for k, members in enumerate(self.members):
            rows = np.flatnonzero(group == k)
            votes, sums, least = (np.zeros((len(rows), len(members))) for _ in range(3))
            least += 1
            for p, (a, b) in enumerate(self.pairs):
                if a not in members:
                    continue
                i, j, m = members.index(a), members.index(b), margins[rows, f + p]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                least[:, i] = np.minimum(least[:, i], sure[rows, f + p])
                least[:, j] = np.minimum(least[:, j], 1 - sure[rows, f + p])
            best = (votes + sums / (1 + np.abs(sums).max(initial=0)) / 2).argmax(1) if len(rows) else np.zeros(0, int)
            lang[rows] = np.array(members)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return lang, score


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> Hierarchy | None:
    """Learns from docs that aren't held out; None if none has a language and letters."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("h"))
    # Rows that repeat id and text are one; only then is it known how low a language's lowest hashes lie.
    hashed = materialise(known.select("lang", "h").distinct(), "hashes")
    often = {r["lang"]: r["count"] for r in hashed.groupBy("lang").count().collect()}
    if not often:
        return None
    sample = max(1, min(sample, rows // len(often)))
    # Few hashes of each language are low enough to be looked at, so none's rows are sorted in one task.
    low = F.create_map(*[F.lit(x) for lang, n in sorted(often.items()) for x in (lang, hash_limit(n, sample))])
    lowest = hashed.filter(F.col("h") <= F.try_element_at(low, F.col("lang")))
    lowest = lowest.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample)
    # A number for each language; the texts themselves stay where they are.
    limits = {r["lang"]: r["limit"] for r in lowest.groupBy("lang").agg(F.max("h").alias("limit")).collect()}
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    chosen = known.filter(F.col("h") <= F.try_element_at(limit, F.col("lang")))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))  # `sample` rows of a language at most, repeated ones once
    got = chosen.select("text", "lang").mapInArrow(_sample_rows, "lang string, gram array<int>, n array<int>").orderBy("lang", F.hash("gram", "n")).collect()
    return Hierarchy([(r.lang, r.gram, r.n) for r in got]) if got else None


def _predict_rows(model: Hierarchy | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for lo, hi, data, at in text_slices(texts, 1 << 20):
                n = hi - lo
                lengths = np.diff(at)
                lang, score, letters = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                if model is not None:
                    ascii_letter = np.concatenate([[0], np.cumsum(_LETTERS[data] & (data < 128))])
                    letters = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
                    high = np.concatenate([[0], np.cumsum(data >= 128)])
                    for k in np.flatnonzero(~letters & (high[at[1:]] > high[at[:-1]])).tolist():
                        letters[k] = bool(_ANY_LETTER.search(bytes(data[at[k] : at[k + 1]]).decode()))
                    grams, first = trigrams(data, at)
                    margins = np.zeros((n, len(model.weights)))
                    sizes = np.diff(first)
                    # Root frequencies: count each trigram of a text once, weighted by the root of its count.
                    key = np.repeat(np.arange(n), sizes) << BITS | grams
                    key, counts = np.unique(key, return_counts=True)
                    owner = key >> BITS
                    value = np.sqrt(counts / np.maximum(1, sizes)[owner])
                    for m, w in enumerate(model.weights):
                        margins[:, m] = np.bincount(owner, value * w[key & ((1 << BITS) - 1)], n) + w[-1]
                    lang, score = model.predict(margins)
                names = [model.langs[k] if ok and size else UNKNOWN for k, ok, size in zip(lang, letters, lengths, strict=True)] if model is not None else [UNKNOWN] * n
                kept = {name: batch.column(name).slice(lo, n) for name in batch.schema.names if name != "text"}
                yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))})

    return rows


def predict(docs: DataFrame, model: Hierarchy | None, *more: Column) -> DataFrame:
    """doc_id, more columns (none named `text`), lang_pred and score of every document."""
    read = docs.select("doc_id", *more, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    return read.mapInArrow(_predict_rows(model), f"{kept}, lang_pred string, score double")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told (isn't `und`), all columns. Rows that share a doc_id are told apart by their texts."""
    told = predict(docs, train(docs), text_key().alias("key")).filter(F.col("lang_pred") != UNKNOWN)
    return rows_of(docs, told.select(F.col("doc_id").alias("id"), "key"), text_key())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
