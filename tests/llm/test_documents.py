"""Each document operator against brute force on difficult rows, empty tables and rows without ids."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose, rows
from wavecrate.llm import exact_dedup, language, licenses, mixing, near_dedup, pieces, sstable, suffix_dedup, toxicity

TEXTS = [(d, t or "") for d, t, *_ in rows()]


def collected(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, bits):
    """With 3 bits nearly all chunk hashes clash, so identifiers need their ordinals."""
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(t, []).append(d)
    want = Counter((d, max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in TEXTS)
    got = collected(exact_dedup.exact_groups(docs, bits))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_keeps_columns(docs):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, *range(3, 4), 5, *range(6, 18)]


def word_bag(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similar(a, b):
    shared = sum((a & b).values())
    return shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) - 1e-9


def brute_classes(texts):
    bags, root = [word_bag(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and (similar(bags[i], bags[j])) or texts[i][0] == texts[j][0]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {texts[k][0]: min(texts[m][0] for m in range(len(texts)) if root[m] == root[k]) for k in range(len(texts))}


def test_near(docs):
    got = collected(near_dedup.near_groups(docs))
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(TEXTS) and len(got) == len(TEXTS)
    assert near_dedup.near_dedup(docs).columns == docs.columns


def test_near_large_group(spark):
    """A group of many edits of one text: links that don't go through the smallest member must be found too."""
    base, texts = prose(9, 100).split(), []
    rng = np.random.default_rng(1)
    for k in range(120):
        words = list(base)
        for _ in range(int(rng.integers(0, 6))):
            words[rng.integers(100)] = f"edit{rng.integers(10**6)}"
        texts.append((k, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute_classes(texts)
    assert sum(got[k] == want[k] for k in got) >= 118  # bands miss a pair at the threshold once in over a thousand


def test_near_signatures_are_unbiased():
    rng, errors = np.random.default_rng(2), []
    for _ in range(10):
        shingle = np.unique(rng.integers(0, 2**48, 200).astype(np.uint64))
        a, b = rng.integers(0, 9, len(shingle)), rng.integers(0, 9, len(shingle))
        b = np.where(rng.random(len(shingle)) < 0.6, a, b)
        one, two = (near_dedup.signatures(np.zeros((w > 0).sum(), int), shingle[w > 0], w[w > 0], 1, 2048)[0] for w in (a, b))
        errors.append((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012


def brute_repeats(texts):
    holder = {}
    for d, t in texts:
        b = t.encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            holder[w] = min(holder.get(w, d), d)
    out = Counter()
    for d, t in texts:
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(b) - 49):
            if holder[b[s : s + 50]] < d:
                gone[s : s + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(docs, hot):
    got = collected(suffix_dedup.remove_repeats(docs, texts=True, hot=hot))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(TEXTS)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_order():
    """Previous smaller owners among equal stretches, by hand."""
    text = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50 + b"x" * 50, np.uint8)
    owner = np.repeat([1, 2, 2, 3], 50)
    assert suffix_dedup.earlier_matches(text, owner, np.array([0, 50, 100, 150])).tolist() == [False, False, True, True]


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path(pieces.MODEL))
    want = Counter((d, tuple(model.encode(t)), model.decode(model.encode(t)) if t else "") for d, t in TEXTS)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in collected(pieces.encode(docs))) == want
    digests = Counter((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in want.elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(pieces.encode_digests(docs))) == digests


def test_pieces_on_random_strings():
    import random

    import sentencepiece

    path = pieces.tokenizer_path(pieces.MODEL)
    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path), random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice("ab e\n\t  ▁éñ日😀.-'<0xA>thing") for _ in range(rng.randint(1, 30)))
        ids = model.encode(text)
        assert own.encode_decode(text) == (",".join(map(str, ids)), model.decode(ids).encode())


def test_sstable(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(sstable.tokenizer_path(sstable.TOKENIZER))
    folder = sstable.scratch_path(spark, "test")
    manifest = sstable.write_shards(docs, folder)
    got, start = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in collected(sstable.read_shards(spark, folder, manifest))), 0
    for (at, doc, n, crc), (d, t) in zip(got, sorted(TEXTS), strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (at, doc, n, crc) == (start, d, len(ids), zlib.crc32(ids))
        start += n


def test_shard_lookup(tmp_path):
    path = tmp_path / "x.sst"
    writer = sstable.ShardWriter(path.open("wb"), 2)
    for k in [None, -5, 3, 3, *range(10, 3000, 7)]:
        writer.add(sstable.key_of(k), np.arange((k or 0) % 90 + 1, dtype="<u2").tobytes() * 3)
    writer.close()
    shard = sstable.Shard(path.read_bytes())
    assert len(shard.blocks) > 1 and len(shard.lookup(3)) == 2 and len(shard.lookup(None)) == 1 and len(shard.lookup(-5)[0]) == 3 * 86
    assert all(len(shard.lookup(k)) == 1 for k in range(10, 3000, 7)) and not any(shard.lookup(k) for k in range(11, 3000, 70))


def test_word_encoder_on_random_strings():
    import random

    own, rng = sstable.encoder(sstable.TOKENIZER), random.Random(5)
    texts = ["".join(rng.choice("ab e\n\t  é日😀.-_'s 12\x1c\x85\r<|endoftext|>") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    want = [own.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, own.kind).tolist() for b in own.encode(texts)] == want


def test_licenses(docs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in collected(licenses.scan(docs))}
    for d, t in TEXTS:
        words, r = re.findall(licenses.WORD, t.translate(fold)), got[d]
        places = [(k, label) for label, p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert got[12]["labels"] == "apache-2,mit" and got[17]["labels"] == "mit" and got[17]["base_labels"] == ""


def test_mixing(docs):
    got = collected(mixing.mix(docs))
    sizes = Counter((d, len(re.findall(mixing.WORD, t))) for d, t in TEXTS)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    totals = {}
    for d, t, _, s, _ in rows():
        totals[s] = totals.get(s, 0) + len(re.findall(mixing.WORD, t or ""))
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, cap = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {s: 2 * totals[s] for s in order}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            target |= share
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(x, 6) for x in target.values()})
    taken = sum(r["taken"] for r in got if r["source_size"] == totals["c"])
    assert abs(taken - target["c"]) <= 3 * mixing.BLOCK_WORDS
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_language(docs):
    got = {r["doc_id"]: r for r in collected(language.predict(docs, language.train(docs)))}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6, 11}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.in_known_language(docs).columns == docs.columns


def test_language_held_out(spark):
    from tests.conftest import SF

    got = language.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    texts = [(k, " ".join(["plain", "words", f"w{rng.integers(99)}", f"v{rng.integers(99)}", *(["idiot"] if k % 2 else [])])) for k in range(200)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probes = ["you idiot", "you i.d.i.o.t", "you 1d1ot", "you i d i o t", "you idiiot", "plain words", "", None]
    got = toxicity.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert all(scores[k] >= 0.5 for k in range(5)) and all(scores[k] < 0.5 for k in (5, 6, 7))
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None


def test_toxicity_bears_difficult_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (9, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    got = collected(toxicity.score(docs, toxicity.train(docs, labels)))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)


def all_of(frame):
    yield exact_dedup.exact_groups(frame)
    yield near_dedup.near_groups(frame)
    yield suffix_dedup.remove_repeats(frame)
    yield pieces.encode_digests(frame)
    yield licenses.scan(frame)
    yield mixing.mix(frame)
    yield language.predict(frame, language.train(frame))
    yield toxicity.score(frame, None)


def test_empty_tables(spark, empty):
    assert [f.count() for f in all_of(empty)] == [0] * 8
    assert sstable.write_shards(empty, sstable.scratch_path(spark, "none")).count() == 0


def test_rows_without_id(nameless):
    assert [f.count() for f in all_of(nameless)] == [2] * 8


def test_an_answer_file_that_another_attempt_wrote_stays(tmp_path):
    from pyarrow import fs

    from wavecrate.llm import suffix_dedup

    class Strict(fs.LocalFileSystem):
        """Moves onto no file that exists, as some stores do."""

        def move(self, src, dest):
            if self.get_file_info(dest).type != fs.FileType.NotFound:
                raise FileExistsError(dest)
            super().move(src, dest)

    system, name = Strict(), str(tmp_path / "7")
    for attempt in range(3):
        draft = tmp_path / f"7.{attempt}"
        draft.write_bytes(b"answer")
        suffix_dedup._published(system, str(draft), name, 6)
        assert [p.name for p in tmp_path.iterdir()] == ["7"] and (tmp_path / "7").read_bytes() == b"answer"
