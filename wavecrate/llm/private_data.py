"""Personal data in texts, also in disguise: rewriting transducers that keep the way back to the source characters.

Base identifiers (email, ip, card, phone) are found in the text as it stands. Then three transducers rewrite it in turn:
look-alike characters become ASCII and invisible ones vanish; runs of spelled digits (four languages, `double`, `plus`,
`dot`, `dash`) become digits; at/dot disguises (`[at]`, `(dot)`, ` at … dot `, `_at_`, `AT … DOT`, spaced signs) become
signs. Each keeps, for every stretch of its output, the stretch of its input; identifiers found in the last text are
mapped back through all of them. Such a span is added if it holds something rewritten and lies in no base span of its
kind; base spans always stay.

Against false alarms: a bare ` at ` counts only where a disguised dot follows, a domain found in disguise must end in
letters, spelled digits need a run of three words at least, and numbers must pass the same checks as plain ones.

Each step is linear in the text, which is read whole. Defined results: null counts as the empty text, which has no
spans; offsets are code points of the source, ends exclusive; repeated rows get equal results; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm.common import table, text_slices

KINDS = ("email", "ip", "card", "phone")
RUN_WORDS = 3  # spelled digits that a run needs

# Cyrillic, Greek and other letters that look like ASCII ones, and signs.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "−": "-",
}
# Digits in English, German, Spanish and French.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
SIGN_WORDS = {"dot": ".", "punkt": ".", "punto": ".", "point": ".", "dash": "-"}
TIMES = {"double": 2, "triple": 3}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _folding() -> dict[int, str]:
    """Characters that are read as one ASCII character: by Unicode's own data, and the look-alikes."""
    out = {}
    for code in range(128, 0x20000):
        sign = chr(code)
        kind, how = unicodedata.category(sign), unicodedata.decomposition(sign)
        if kind == "Nd":
            out[code] = str(unicodedata.digit(sign))
        elif kind == "Zs":
            out[code] = " "
        elif kind == "Pd":
            out[code] = "-"
        elif how.startswith(("<font>", "<wide>", "<small>", "<circle>")) and len(plain := unicodedata.normalize("NFKC", sign)) == 1 and plain.isascii():
            out[code] = plain
    return out | {ord(k): v for k, v in LOOKALIKES.items()}


FOLDING = _folding()
FOLDED = frozenset(map(chr, FOLDING)) | frozenset(INVISIBLE)
HIDDEN = re.compile(f"[{INVISIBLE}]")

# Base identifiers. Runs are taken whole (a later start in a run that failed would fail alike), which keeps them linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def local_start(text: str, end: int, least: int) -> int:
    """Where the run of local-part characters that ends at `end` starts, not before `least`."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base identifiers, in order."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start, domain = local_start(text, at, done), DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            found.append((start, 0, done))
        at = text.find("@", at + 1 if done <= at else done)
    if NUMBER.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


class Tape:
    """A text that transducers rewrite in turn, with the way back to its source."""

    def __init__(self, text: str) -> None:
        self.text, self.stages = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches (start, end, new text), given in order and apart."""
        if not edits:
            return
        out, starts, sources, ends, size, done = [], [], [], [], 0, 0

        def add(piece: str, source: int, end: int) -> None:
            nonlocal size
            if piece:
                out.append(piece)
                starts.append(size)
                sources.append(source)
                ends.append(end)
                size += len(piece)

        for start, end, new in edits:
            add(self.text[done:start], done, -1)  # -1: copied, character by character
            add(new, start, end)
            done = end
        add(self.text[done:], done, -1)
        self.text = "".join(out)
        self.stages.append((starts, sources, ends))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source's stretch for a stretch of at least one character of the text."""
        for starts, sources, ends in reversed(self.stages):
            a, b = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            start = sources[a] + start - starts[a] if ends[a] < 0 else sources[a]
            end = sources[b] + end - starts[b] if ends[b] < 0 else ends[b]
        return start, end


def lowered(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fold(tape: Tape) -> None:
    """First transducer: look-alikes and invisible characters."""
    text = tape.text
    if text.isascii():
        return
    try:  # most texts with accents lie in Latin-1, where few characters are folded
        text.encode("latin-1")
        some = "\xa0" in text or "\xad" in text
    except UnicodeEncodeError:
        some = not FOLDED.isdisjoint(text)
    if some:
        tape.text = tape.text.translate(FOLDING)  # keeps all places
        tape.rewrite([(m.start(), m.end(), "") for m in HIDDEN.finditer(tape.text)])




def _either(words: list[str]) -> str:
    """One of the words, branching by letters, so that few alternatives are tried at a place."""
    heads = sorted({w[0] for w in words if w})
    out = "|".join(h + _either([w[1:] for w in words if w[:1] == h]) for h in heads)
    return f"(?:{out})" + ("?" if "" in words else "") if heads else ""


_DIGIT = _either(list(DIGIT_WORDS))
_SIGN = "(?:" + "|".join(SIGN_WORDS) + ")"
_GAP = r"[\x20\t,-]{1,2}"
#: The second and third word of a run; it starts with what stands before every such word.
SECOND = re.compile(rf"[\x20\t,-]{_DIGIT}{_GAP}(?:(?:double|triple|{_SIGN}){_GAP})?{_DIGIT}")
_ITEM = rf"(?:(?:(?:double|triple)\x20)?{_DIGIT}(?![a-zà-ÿ])|[0-9]{{1,6}}(?![0-9a-z])|{_SIGN}(?![a-zà-ÿ]))"
SPELLED = re.compile(rf"(?<![a-z0-9à-ÿ])(?:plus(?={_GAP}(?:{_DIGIT}|[0-9]))|{_ITEM})(?:{_GAP}{_ITEM})*+")
ITEM = re.compile(rf"plus|(?:(double|triple)\x20)?({_DIGIT})(?![a-zà-ÿ])|[0-9]+|{_SIGN}")


def spelled_digits(tape: Tape) -> None:
    """Second transducer: runs of digit words, with signs and digits among them; what separates them vanishes."""
    low = lowered(tape.text)
    if not SECOND.search(low):
        return
    edits = []
    for run in SPELLED.finditer(low):
        items = list(ITEM.finditer(low, run.start(), run.end()))
        if sum(m[2] is not None for m in items) < RUN_WORDS:
            continue
        done = run.start()
        for m in items:
            edits.append((done, m.start(), ""))
            new = "+" if m[0] == "plus" else DIGIT_WORDS[m[2]] * TIMES.get(m[1], 1) if m[2] else SIGN_WORDS.get(m[0])
            if new:
                edits.append((m.start(), m.end(), new))
            done = m.end()
    tape.rewrite([e for e in edits if e[0] < e[1]])


_OPEN, _CLOSE = r"[\x20\t]{0,4}[\[({<]{1,2}[\x20\t]{0,4}", r"[\x20\t]{0,4}[\])}>]{1,2}[\x20\t]{0,4}"
_DOTS = r"(?:dot|punkt|punto|point)"
BRACKETED = re.compile(r"[\[({<][\x20\t]{0,4}(?:at|@|arroba|\.)[\x20\t]{0,4}[\])}>]")
DOT_WORDS = ("dot", "punkt", "punto", "point")
BRACKET_AT = re.compile(rf"{_OPEN}(?:at|@|arroba){_CLOSE}")
BARE_AT = re.compile(r"[\x20_-]{1,3}at[\x20_-]{1,3}(?=[a-z0-9])")
SIGN_AT = re.compile(r"@[\x20\t]{0,4}")
GLUED = re.compile(r"(?<=[a-z0-9])AT(?=[a-z0-9-]+DOT[a-z])")
_DOT_TEXT = rf"{_OPEN}(?:{_DOTS}|\.){_CLOSE}|[\x20_-]{{1,3}}{_DOTS}[\x20_-]{{1,3}}"
DOT = re.compile(rf"(?:{_DOT_TEXT})(?=[a-z0-9])")
SPACED_DOT = re.compile(r"[\x20\t]{1,3}\.[\x20\t]{1,3}(?=[a-z0-9])")
GLUED_DOT = re.compile(r"DOT(?=[a-z0-9])")
DOT_BEFORE = re.compile(rf"(?:{_DOT_TEXT})\Z")
#: A label of at most 63 characters, which ends before a hyphen that is part of a disguise.
LABEL = re.compile(rf"(?=[a-z0-9])(?:[a-z0-9]|-(?!-?{_DOTS}[\x20_-])(?=[a-z0-9-])){{1,63}}+")
LAST = re.compile(r"[a-z]{2,24}\Z")
MOST_LABELS, LOCAL_CHARS = 64, 64  # a name server's and a mail server's own limits, rounded up


def _domain(text: str, low: str, at: int, spaced: bool) -> tuple[int, list[tuple[int, int, str]]]:
    """Where a domain in plain or disguised form that starts at `at` ends (-1: there is none), and the edits of its dots."""
    label, edits, labels = LABEL.match(low, at), [], 1
    while label and labels <= MOST_LABELS:
        start, end = label.span()
        inner = text.find("DOT", start + 1, end)
        if inner > 0 and (more := LABEL.match(low, inner + 3)):
            edits.append((inner, inner + 3, "."))
        elif low[end : end + 1] == "." and (more := LABEL.match(low, end + 1)):
            pass
        elif (dot := DOT.match(low, end) or GLUED_DOT.match(text, end) or spaced and SPACED_DOT.match(low, end)) and (more := LABEL.match(low, dot.end())):
            edits.append((end, dot.end(), "."))
        else:
            return (end if labels > 1 and LAST.match(low, start, end) else -1), edits
        label, labels = more, labels + 1
    return -1, []


def _local(text: str, low: str, end: int, least: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Where the local part that ends at `end` starts (`end`: there is none), and the edits of disguised dots in it."""
    first, edits = local_start(text, end, max(least, end - LOCAL_CHARS)), []
    while first < end and end - first < LOCAL_CHARS and (dot := DOT_BEFORE.search(low[max(least, first - 24) : first])):
        middle = first - len(dot[0])
        before = local_start(text, middle, max(least, middle - LOCAL_CHARS))
        if before == middle:
            break
        edits.insert(0, (middle, first, "."))
        first = before
    return first, edits


def at_and_dot(tape: Tape) -> None:
    """Third transducer: disguised signs of addresses, where a local part and a domain stand around them."""
    text, low = tape.text, lowered(tape.text)
    if not ("@" in low and (" @" in low or "\t@" in low) or any(w in low for w in DOT_WORDS) or BRACKETED.search(low)):
        return
    # 1: in brackets or glued; 2: a sign between spaces; 3: bare, or a sign that stands as it should, where the dot must be disguised.
    signs = [(m.start(), m.end(), 1) for pattern, where in ((BRACKET_AT, low), (GLUED, text)) for m in pattern.finditer(where)]
    signs += [(m.start(), m.end(), 3) for m in BARE_AT.finditer(low) if m.start() and low[m.start() - 1].isalnum()]
    for m in SIGN_AT.finditer(low):
        start = m.start() - next(k for k in range(5) if k == 4 or low[m.start() - k - 1 : m.start() - k] not in (" ", "\t"))
        signs.append((start, m.end(), 2 if start < m.start() and m.end() > m.start() + 1 else 3))
    edits, done = [], 0
    for start, end, how in sorted(signs):
        if start < done:
            continue
        stop, dots = _domain(text, low, end, how == 2)
        if stop < 0 or how == 3 and not dots:
            continue
        first, left = _local(text, low, start, done)
        if first < start:
            edits += [*left, (start, end, "@"), *dots]
            done = stop
    tape.rewrite(edits)


def private_spans(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, disguised, the identifier in plain form) of all spans, by start, kind and end."""
    base = identifiers(text)
    spans = {(s, k, e): (False, text[s:e]) for s, k, e in base}
    tape = Tape(text)
    for transducer in (fold, spelled_digits, at_and_dot):
        transducer(tape)
    if tape.text is not text:
        own: list[list[tuple[int, int]]] = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
        for start, kind, end in identifiers(tape.text):
            s, e = tape.source(start, end)
            plain = tape.text[start:end]
            before = bisect_right(own[kind], (s, len(text))) - 1
            inside = before >= 0 and own[kind][before][1] >= e
            if plain != text[s:e] and not inside:
                spans[s, kind, e] = (True, plain)
    return [(KINDS[k], s, e, *rest) for (s, k, e), rest in sorted(spans.items())]


SPANS = "array<struct<kind string, start long, end long, disguised boolean, plain string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_()), ("plain", pa.string())])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in text_slices(batch.column(1)):
            spans = [[dict(zip(("kind", "start", "end", "disguised", "plain"), s, strict=True)) for s in private_spans(t or "")] for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "spans": pa.array(spans, pa.list_(_SPAN))})


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, disguised, plain) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_span_rows, f"doc_id {kind}, spans {SPANS}")


def redact(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of the first in capitals."""
    out, done = [], 0
    for kind, start, end, *_ in private_spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _redacted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in text_slices(batch.column(1)):
            texts = [None if t is None else redact(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "text": pa.array(texts, pa.string())})


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the redacted text of every row; null stays null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_redacted_rows, f"doc_id {kind}, text string")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: ~s["disguised"])
    found = find_private(table(spark, sf_dir, "documents")).withColumn("base", base)
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


QUERIES = {"op12_private_data": op12_private_data}
