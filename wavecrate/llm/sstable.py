"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by id; each task encodes its documents and streams them into shard files:

    shard  := block* bloom index footer
    block  := entry*; entry := varint shared, varint suffix length, varint value length, key suffix, value
    index  := for each block: varint key length, first key, varint offset, varint length, varint token ids before it
    footer := 7 little-endian 64-bit numbers (bloom offset, index offset, blocks, entries, token ids, id width, hashes) and 8 bytes of magic

A key is one byte 0 for null, or 1 and the id as an order-preserving 8-byte integer; a block spells its first key in
full and of later ones only what differs from the key before. A value holds the ids as little-endian integers of the
footer's width. The block index is sparse (a key a block), so a lookup asks the Bloom filter, bisects the index and
scans one block. Files get unique names; only those in the manifest that finished tasks return count, so a retried
task leaves no rows behind.

Defined results: null and empty texts hold the end id alone; rows that share a doc_id are all kept, in the order of
their texts' hashes, over as many tasks and shards as they need; null ids sort first; an empty table gives an empty result; extra columns are ignored. A task holds one
text, one block and the index of its shard.
"""

from __future__ import annotations

import os
import re
import string
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, mix64, scratch_path, table, tokenizer_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"WCSST001"
CACHE_ENTRIES, CACHE_KEY_CHARS = 300_000, 64  # of a generation of two
JOINED = 4_096  # parts that the library gets as one text


class WordEncoder:
    """Exactly the tokenizers library's ids, with the ids of space-delimited parts kept.

    The byte-level pre-tokenizer always splits before a space that a character other than white space follows, so a
    text's ids are those of its first part and of each later one with its space. Parts that aren't known yet go to the
    library many to a text, and the ids are told apart by the bytes that they stand for. Texts that hold the string of
    an added token go to the library whole.
    """

    odd = re.compile(r" (?:\s|$)")  # a space that no word follows
    between = re.compile(r" (?=\S)")
    marks = string.punctuation  # neither letters, digits nor white space
    plain = "\u024f"  # up to here all Unicode versions agree on letters

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [x.content for x in self.lib.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.lib.get_vocab()
        self.spelt = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id; a character of the byte alphabet each
        self.spelt[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation that `known` follows

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _later(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts, each with the space before it."""
        width, out = np.dtype(self.kind).itemsize, {}
        for lo in range(0, len(parts), JOINED):
            some = parts[lo : lo + JOINED]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            reach, upto = np.cumsum(self.spelt[ids]), np.cumsum([len(p.encode()) + 1 for p in some])
            ends = np.searchsorted(reach, upto) + 1
            if ends[-1] > len(ids) or (reach[ends - 1] != upto).any():
                raise ValueError("not a byte-level tokenizer without a normalizer")
            flat, cuts = ids.tobytes(), (ends * width).tolist()
            out.update(zip(some, map(flat.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        return out

    def _learn(self, parts: set[str]) -> list[str]:
        """Makes all parts known; returns those that are too long to stay so."""
        known, before, todo, marked, marks, plain = self.known, self.before, {}, [], self.marks, self.plain
        for p in parts:
            if p in before:
                known[p] = before[p]
                continue
            core = p.rstrip(marks)
            if core != p and core.isalpha() and max(core) <= plain:  # letters and marks are split
                marked.append((p, core, p[len(core) :]))
                if core in known:
                    continue
                if core in before:
                    known[core] = before[core]
                    continue
                p = core
            todo[p] = None
        tails = list({tail for *_, tail in marked})
        after = dict(zip(tails, self._ids(tails), strict=True))
        known.update(self._later(list(todo)))
        known.update({p: known[core] + after[tail] for p, core, tail in marked})
        return [p for p in [*parts, *todo] if len(p) > CACHE_KEY_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes. Parts that aren't known yet are encoded together."""
        out, heads, split, missing = [b""] * len(texts), {}, {}, set()
        whole = [k for k, text in enumerate(texts) if any(a in text for a in self.added)]
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids
        for k, text in enumerate(texts):
            if not text or out[k]:
                continue
            parts = text.split(" ")
            new = set(filterfalse(self.known.__contains__, parts[1:]))
            if new and self.odd.search(text):
                parts = self.between.split(text)
                new = set(filterfalse(self.known.__contains__, parts[1:]))
            heads[k], split[k] = parts[0], parts[1:]
            missing |= new
        long = self._learn(missing) if missing else []
        known = self.known.__getitem__
        for (k, parts), first in zip(split.items(), self._ids(list(heads.values())), strict=True):
            out[k] = first + b"".join(map(known, parts))
        for p in long:
            self.known.pop(p, None)
        if len(self.known) > CACHE_ENTRIES:  # what is used again comes back from the older generation
            self.known, self.before = {}, self.known
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        _encoders[name] = WordEncoder(tokenizer_path(name))
    return _encoders[name]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The bits of each key, by double hashing."""
    raw = np.array([int.from_bytes(k[-8:], "big") for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        a, b = mix64(raw), mix64(raw ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Streams sorted entries into one shard."""

    def __init__(self, stream, width: int) -> None:
        self.stream, self.width, self.at, self.ids, self.block, self.index = stream, width, 0, 0, [], []
        self.block_bytes, self.last, self.keys, self.entries = 0, b"", [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.index.append([key, self.at, 0, self.ids])
            shared = 0
        else:
            shared = next((k for k, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.last = key
        self.keys.append(int.from_bytes(key[-8:], "big"))
        self.entries += 1
        self.ids += len(value) // self.width
        if self.block_bytes >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index[-1][2] = self.block_bytes
            self.stream.write(b"".join(self.block))
            self.at += self.block_bytes
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self.flush()
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        for lo in range(0, len(self.keys), 65_536):
            bloom[bloom_places([k.to_bytes(8, "big") for k in self.keys[lo : lo + 65_536]], bits, BLOOM_HASHES).ravel()] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) + varint(ids) for k, at, n, ids in self.index)
        self.stream.write(bloom + index + struct.pack("<7Q", self.at, self.at + len(bloom), len(self.index), self.entries, self.ids, self.width, BLOOM_HASHES) + MAGIC)
        self.stream.close()


class Shard:
    """Reads a shard from its bytes."""

    def __init__(self, data) -> None:
        self.data = memoryview(data).cast("B")
        if bytes(self.data[-8:]) != MAGIC:
            raise ValueError("not a shard")
        self.bloom_at, index_at, blocks, self.entries, self.ids, self.width, self.hashes = struct.unpack("<7Q", self.data[-64:-8])
        self.blocks, at = [], index_at
        for _ in range(blocks):
            n, at = read_varint(self.data, at)
            key, at = bytes(self.data[at : at + n]), at + n
            start, at = read_varint(self.data, at)
            size, at = read_varint(self.data, at)
            before, at = read_varint(self.data, at)
            self.blocks.append((key, start, size, before))

    def scan(self, block: int) -> Iterator[tuple[bytes, int, memoryview]]:
        """Key, token ids before it in the shard, and value of each entry of a block."""
        _, at, size, ids = self.blocks[block]
        end, key = at + size, b""
        while at < end:
            shared, at = read_varint(self.data, at)
            more, at = read_varint(self.data, at)
            n, at = read_varint(self.data, at)
            key = key[:shared] + bytes(self.data[at : at + more])
            at += more
            yield key, ids, self.data[at : at + n]
            at += n
            ids += n // self.width

    def may_hold(self, key: bytes) -> bool:
        bits = struct.unpack("<Q", self.data[self.bloom_at : self.bloom_at + 8])[0]
        return all(self.data[self.bloom_at + 8 + (p >> 3)] >> (p & 7) & 1 for p in bloom_places([key], bits, self.hashes)[0].tolist())

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found, k = [], max(0, bisect_right([b[0] for b in self.blocks], key) - 1)
        while k > 0 and self.blocks[k][0] == key:  # rows that share an id may fill several blocks
            k -= 1
        for block in range(k, len(self.blocks)):
            if self.blocks[block][0] > key:
                break
            found += [np.frombuffer(v, f"<u{self.width}") for at, _, v in self.scan(block) if at == key]
        return found


def _open(folder: str, name: str):
    """A stream to a file of the shared folder, on whatever file system that is."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}")


def _write_rows(folder: str, tokenizer: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], own.kind).tobytes(), np.dtype(own.kind).itemsize
        name, writer, done = "", None, {"shard": [], "part": [], "seq": [], "n_docs": [], "n_ids": []}

        def finish() -> None:
            writer.close()
            for k, v in zip(done, (name, part, seq, writer.entries, writer.ids), strict=True):
                done[k].append(v)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 128):
                for doc, value in zip(ids[lo : lo + 128], own.encode([x.as_py() or "" for x in texts.slice(lo, 128)]), strict=True):
                    if writer is None:
                        name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        writer = ShardWriter(_open(folder, name), width)
                    writer.add(key_of(doc), value + end)
                    if writer.at >= SHARD_BYTES:
                        finish()
                        writer, seq = None, seq + 1
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "shard" else pa.int64()) for k, v in done.items()})

    return rows


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes all documents and returns the manifest: shard, part, seq, n_docs, n_ids and ids_before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    made = materialise(rows.mapInArrow(_write_rows(folder, tokenizer, end_id), "shard string, part long, seq long, n_docs long, n_ids long"), "manifest")
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)  # a row a shard
    return made.withColumn("ids_before", F.sum("n_ids").over(ahead) - F.col("n_ids"))


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_buffer())
            kind = f"<u{shard.width}"
            for block in range(len(shard.blocks)):
                got = [(id_of(k), at, len(v) // shard.width, zlib.crc32(np.frombuffer(v, kind).astype("<u4"))) for k, at, v in shard.scan(block)]
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), *[pa.array(c, pa.int64()) for c in columns]], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = files.mapInArrow(_read_rows, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = rows.join(manifest.select("shard", "ids_before"), "shard")
    return rows.select("doc_id", (F.col("at") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "sst")
    manifest = write_shards(docs, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)


QUERIES = {"op4_sstable": op4_sstable}
