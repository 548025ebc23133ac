"""SentencePiece merge-type (BPE) encoding and decoding, exact, by backtracking.

A text is first cut where no vocabulary piece spans the cut, so each part is encoded on its own and frequent parts are
encoded once per worker. Inside a part, an Aho-Corasick automaton gives the longest piece at each position. Tokens are
taken longest first; a token may follow another only if re-merging the two around their border would leave them as
they are; when nothing fits, the last token is taken back and its start marked in a bitfield of failed positions.

Defined results: null and empty texts have no ids and decode to an empty text; characters outside the vocabulary
become byte pieces; ties and repeated rows give equal results; an empty table gives an empty result; extra columns are
ignored. Memory is bounded by one text and a cache that is emptied at a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavecrate.llm.common import table, tokenizer_path

MODEL = "piece_bpe_32k.model"
CACHE_ENTRIES, CACHE_KEY_CHARS = 500_000, 64
SPACE = "▁"
NEVER = 1 << 60


class PieceCodec:
    """Encoder and decoder of one merge-type model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.byte_ids, self.spelt = [0] * 256, {}
        scores = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.spelt[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], scores[piece] = i, model.get_score(i)
                self.spelt[i] = piece.replace(SPACE, " ").encode()
        self.unknown = model.unk_id()
        # A better score merges earlier; rank 0 merges first. Equal scores share a rank.
        order = {s: r for r, s in enumerate(sorted({scores[p] for p in scores if len(p) > 1}, reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items() if len(p) > 1}
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.ids:
                    self.shorter[piece] = piece[:n]
                    break
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple] = {}
        inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.cuts_at_space = not any(x[1] == SPACE and x[0] != SPACE for x in inner)
        self.odd_space = SPACE in inner or any(x[0] == SPACE for x in inner)
        self.known: dict[str, str] = {}
        self.texts: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Plain merging: the best-ranked neighbouring pair, leftmost first, until none is left. Also the pairs merged."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            steps.append((parts[best], parts[best + 1]))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts, steps

    def _edge(self, piece: str) -> tuple:
        """How merging makes the piece: 0 not at all, 1 with a later rank before an earlier one, 2 in the order of ranks.

        For 2, also the pieces that stand at its left and right end in turn, with the rank that ends each.
        """
        found = self.edges.get(piece)
        if found is None:
            parts, steps = self.merged(piece)
            left, right = [], []
            ranks = [self.rank[x + y] for x, y in steps]
            how = 0 if len(parts) > 1 else 1 if ranks != sorted(ranks) else 2
            if how == 2:
                # The last step makes the piece; walk back down its two sides.
                made = {}
                for x, y in steps:
                    made[x + y] = (x, y)
                for side, at in ((left, 0), (right, 1)):
                    node, ends = piece, NEVER
                    while True:
                        side.append((node, ends))
                        if len(node) == 1:
                            break
                        ends, node = self.rank[node], made[node][at]
                    side.reverse()
            found = self.edges[piece] = (how, left, right)
        return found

    def fits(self, before: str, after: str) -> bool:
        """Whether merging before + after gives exactly these two pieces."""
        how_a, _, xs = self._edge(before)
        how_b, ys, _ = self._edge(after)
        if not (how_a and how_b):
            return False
        if how_a + how_b < 4:  # the order of the merges isn't that of the ranks, so merge in full
            return self.merged(before + after)[0] == [before, after]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            joins = self.rank.get(x + y, NEVER)
            if joins < x_ends and joins <= y_ends and joins < NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _stretch(self, text: str) -> list[str]:
        """Pieces of a text whose every character is in the vocabulary."""
        size = len(text)
        longest = [1] * size
        for end, n in self.automaton.iter(text):  # ends ascend, so the last match from a start is its longest
            longest[end - n + 1] = n
        failed = bytearray((size >> 3) + 1)
        out, at, pairs, before = [], 0, self.pairs, ""
        token = text[: longest[0]]
        while at < size:
            end = at + len(token)
            good = not failed[end >> 3] >> (end & 7) & 1
            if good:
                key = (before, token)
                good = pairs.get(key)
                if good is None:
                    if len(pairs) > CACHE_ENTRIES:
                        pairs.clear()
                    good = pairs[key] = self.fits(before, token) if before else self._edge(token)[0] > 0
            if good:
                out.append(token)
                before, at = token, end
                if at < size:
                    token = text[at : at + longest[at]]
                continue
            while token not in self.shorter:
                # Nothing shorter: this position fails, and the last token is taken back.
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    return self.merged(text)[0]
                token = out.pop()
                at -= len(token)
                before = out[-1] if out else ""
            token = self.shorter[token]
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part, in which spaces are written as the space symbol."""
        ids, run, known = [], [], self.ids
        for c in part:
            if c in known:
                run.append(c)
                continue
            if run:
                ids += [known[p] for p in self._stretch("".join(run))]
                run = []
            ids += [self.byte_ids[b] for b in c.encode()]
        if run:
            ids += [known[p] for p in self._stretch("".join(run))]
        return ids

    def decode_ids(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, without the removal of the dummy prefix."""
        return b"".join([self.spelt[i] for i in ids])

    def _learn(self, part: str) -> tuple[str, bytes]:
        ids = self.encode_part(part)
        return ",".join(map(str, ids)), self.decode_ids(ids)

    def encode_decode(self, text: str) -> tuple[str, bytes]:
        """All ids as decimal numbers joined by commas, and the decoded text in UTF-8."""
        if not text:
            return "", b""
        # Each part is a run of spaces with what follows it; the dummy prefix belongs to the first part.
        parts = re.findall(" *[^ ▁]+| +|▁[^ ▁]*", text) if "  " in text or SPACE in text or text[0] == " " or text[-1] == " " else None
        known, texts = self.known, self.texts
        if parts is None:
            parts = text.split(" ")  # a space stands before every part, for the first as the dummy prefix
        elif SPACE in text or not self.cuts_at_space:
            ids, body = self._learn(SPACE + text.replace(" ", SPACE))
            return ids, body[1:]
        else:
            parts[0] = " " + parts[0]
            # "x" stands for " x" in the cache, so a part that doesn't begin with a space can't occur here.
            parts = [p[1:] for p in parts]
        found = [known.get(p) for p in parts]
        changed = bool(texts)  # whether decoding may change some part; emptying the caches doesn't take that back
        if None in found:
            for k, p in enumerate(parts):
                if found[k] is None and (got := known.get(p)) is not None:
                    found[k] = got
                elif found[k] is None:
                    found[k], body = self._learn(SPACE + p.replace(" ", SPACE))
                    differs = body != b" " + p.encode()
                    changed |= differs
                    if len(p) <= CACHE_KEY_CHARS:
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                            texts.clear()
                        known[p] = found[k]
                        if differs:
                            texts[p] = body
        ids = ",".join(found)
        if changed:  # decode this text from its ids
            return ids, self.decode_ids(list(map(int, ids.split(","))))[1:]
        return ids, (" " + " ".join(parts)).encode()[1:]


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def _encode_rows(model: str, digest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(model))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for lo in range(0, batch.num_rows, 256):
                counts, hashes, bodies, lists = [], [], [], []
                for value in column.slice(lo, 256):
                    ids, body = own.encode_decode(value.as_py() or "")
                    counts.append(ids.count(",") + 1 if ids else 0)
                    if digest:
                        hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                        bodies.append(hashlib.sha256(body).hexdigest())
                    else:
                        lists.append(list(map(int, ids.split(","))) if ids else [])
                        bodies.append(body.decode())
                doc = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, 256)
                out = {"doc_id": doc, "n_tokens": pa.array(counts, pa.int64())}
                out |= {"ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(bodies, pa.string())} if digest else {"ids": pa.array(lists, pa.list_(pa.int32())), "decoded": pa.array(bodies, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return rows


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode_rows(model, False), f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """As encode, with SHA-256 digests of the ids and of the decoded text in their place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode_rows(model, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
