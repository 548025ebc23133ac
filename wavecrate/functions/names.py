"""Names as columns: extensions, cleanup, parsing, safe names, keys and small predicates. JVM-side expressions only.

Word borders and \\w count ASCII letters, digits and _ alone; white space includes the no-break and other Unicode spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

S = r"[\s   -     　﻿]"
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Fixed values.
UNSAFE = r'[\\/:*?"<>|]'
SEPARATORS = (" - ", " – ", " — ", " | ", " / ")
SITE = rf"{B0}(?:[a-z0-9][a-z0-9-]*\.)+(?:ru|com|net|org|me|cc|info|biz|io|fm|su|ua|kz){B1}"
MEDIA = rf"(?:official{S}+)?(?:music{S}+)?(?:video|audio|lyrics?|lyric{S}+video|visualizer|клип|премьера(?:{S}+песни)?|текст{S}+песни)"
TRANSLIT_MARKERS = "(shch|zh|kh|jj|yj|ykh|ogo|ego|nye|sya|tsya|iya|yye)"
MIN_YEAR, MAX_YEAR = 1900, 2100
DASH = "[-–—]"
EDGE = "[-–—|]"

# Key, pattern that must be found, and replacements in order.
CLEANUP = (
    ("clean.underscores", "_", (("_", " "),)),
    ("clean.site", rf"(?iu)[(\[]{S}*{SITE}{S}*[)\]]", ((rf"(?iu){S}*[(\[]{S}*{SITE}{S}*[)\]]", " "),)),
    ("clean.site", rf"(?iu)(?:^{S}*{SITE}{S}*{EDGE}|{EDGE}{S}*{SITE}{S}*$)", ((rf"(?iu)^{S}*{SITE}{S}*{EDGE}{S}*", ""), (rf"(?iu){S}*{EDGE}{S}*{SITE}{S}*$", ""))),
    ("clean.bitrate", rf"(?i)[(\[]?{S}*\d{{2,3}}{S}?(?:kbps|kbit|kb/s){S}*[)\]]?|[(\[]{S}*(?:mp3|flac|wav|m4a){S}*[)\]]", ((rf"(?i){S}*[(\[]?{S}*\d{{2,3}}{S}?(?:kbps|kbit|kb/s){S}*[)\]]?", " "), (rf"(?i){S}*[(\[]{S}*(?:mp3|flac|wav|m4a){S}*[)\]]", " "))),
    ("clean.mediaLabel", r"[(\[][^()\[\]]+[)\]]", ((rf"(?iu){S}*[(\[]{S}*{MEDIA}{S}*[)\]]", " "),)),
    ("clean.spaces", rf"{S}{{2,}}", ((rf"{S}{{2,}}", " "),)),
    ("clean.downloadId", rf"(?:{S}|{DASH})\d{{5,}}$|[(\[]{S}*\d{{5,}}{S}*[)\]]{S}*$", ((rf"{S}*[(\[]{S}*\d{{5,}}{S}*[)\]]{S}*$", ""), (rf"{S}*{DASH}?{S}+\d{{5,}}$", ""), (rf"{S}*{DASH}\d{{5,}}$", ""))),
    ("clean.leftovers", rf"[(\[]{S}*[)\]]|{EDGE}{S}*$|^{S}*{EDGE}", ((rf"{S}*[(\[]{S}*[)\]]{S}*", " "), (rf"{S}*{EDGE}{S}*$", ""), (rf"^{S}*{EDGE}{S}*", ""))),
)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{S}+|{S}+$", "")


def stem(name: Column) -> Column:
    """The name without its extension; a name that begins with its only dot has none."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The extension in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def _rule_step(key: str, test: str, edits: tuple):
    """One rule as a function of the state struct (text, keys)."""

    def step(s: Column) -> Column:
        after = s["t"]
        for pattern, to in edits:
            after = F.regexp_replace(after, pattern, to)
        held = F.array(F.struct(trimmed(after).alias("n")))
        changed = lambda x: F.struct(x["n"].alias("t"), F.array_union(s["k"], F.array(F.lit(key))).alias("k"))
        edited = F.get(F.transform(held, lambda x: F.when((x["n"] != "") & (x["n"] != s["t"]), changed(x)).otherwise(s)), 0)
        return F.when(s["t"].rlike(test), edited).otherwise(s)  # the edits, which are dearer, only run where the test holds

    return step


def cleaned(text: Column) -> tuple[Column, Column]:
    """The cleaned stem, and the keys of the rules that changed it. A rule that would empty the name is skipped.

    Each step is a field of one struct chain built by nested transforms, so no rule is evaluated twice.
    """
    state = F.array(F.struct(F.coalesce(text, F.lit("")).alias("t"), F.array().cast("array<string>").alias("k")))
    for rule in CLEANUP:
        state = F.transform(state, _rule_step(*rule))
    last = F.get(state, 0)
    return trimmed(last["t"]), last["k"]


def parsed(name: Column) -> Column:
    """Struct of artist (null without a separator) and track. The first separator of the list that occurs counts."""
    flat = trimmed(F.regexp_replace(F.regexp_replace(stem(name), "_", " "), rf"{S}+", " "))
    artist, track = F.lit(None).cast("string"), flat
    for sep in reversed(SEPARATORS):
        at = F.instr(flat, sep)
        artist = F.when(at > 0, trimmed(F.substring(flat, F.lit(1), at - 1))).otherwise(artist)
        track = F.when(at > 0, trimmed(F.substring(flat, at + len(sep), F.length(flat)))).otherwise(track)
    return F.struct(artist.alias("artist"), trimmed(F.regexp_replace(track, rf"{S}+\d{{5,}}$", "")).alias("track"))


def compare_form(text: Column) -> Column:
    """Lower case, letters, digits and inner spaces only."""
    return trimmed(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{S[1:-1]}]", ""))


def release_artist(title: Column) -> Column:
    """What stands before the first ' - ', without a trailing number in brackets."""
    at = F.instr(title, " - ")
    return trimmed(F.regexp_replace(F.when(at > 1, F.substring(title, F.lit(1), at - 1)).otherwise(title), rf"{S}*\(\d+\){S}*$", ""))


def safe_file_name(text: Column) -> Column:
    """Without characters that file systems refuse."""
    return F.regexp_replace(text, UNSAFE, "")


def folder_name(genre: Column) -> Column:
    """A genre as a folder; ' / ' becomes ' & ', trailing dots and spaces go, and a name without letter or digit is Unknown."""
    name = F.regexp_replace(safe_file_name(F.regexp_replace(F.coalesce(genre, F.lit("")), " / ", " & ")), rf"[.{S[1:-1]}]+$", "")
    name = trimmed(name)
    return F.when(name.rlike(r"[\p{L}\p{N}]"), name).otherwise("Unknown")


def query_escape(text: Column) -> Column:
    r"""A backslash before each sign that the search language reserves."""
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def correction_key(artist: Column, title: Column) -> Column:
    """Artist and title in lower case, Latin, Cyrillic, digits, _ and single spaces only."""
    part = lambda c: trimmed(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^A-Za-z0-9_а-яё{S[1:-1]}]", ""), rf"{S}+", " "))
    return F.concat(part(artist), F.lit(" "), part(title))


def artist_key(artist: Column) -> Column:
    """The artist in lower case with single spaces."""
    return trimmed(F.regexp_replace(F.lower(F.coalesce(artist, F.lit(""))), rf"{S}+", " "))


def is_ascii(text: Column) -> Column:
    """X19."""
    return text.rlike(r"^[\x00-\x7F]*$")


def is_record_id(text: Column) -> Column:
    """The shape of a UUID, any case."""
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def looks_transliterated(text: Column) -> Column:
    """No Cyrillic, two words of over two characters, and a digraph that transliteration leaves."""
    words = F.size(F.filter(F.split(text, rf"(?:{S}|[-_])+"), lambda w: F.length(w) > 2))
    return ~text.rlike("[а-яА-ЯёЁ]") & (words >= 2) & text.rlike(f"(?i){TRANSLIT_MARKERS}")


def plausible_year(value: Column) -> Column:
    """The leading digits as a year between 1900 and 2100, else null."""
    year = F.regexp_extract(value, rf"^{S}*(\d+)", 1).try_cast("int")
    return F.when(year.between(MIN_YEAR, MAX_YEAR), year)


def matches_filter(query: str, *columns: Column) -> Column:
    """The query, trimmed and in lower case, stands in the non-empty columns joined by spaces."""
    shown = F.concat_ws(" ", *[F.when(c != "", c) for c in columns])
    return F.contains(F.lower(shown), F.lit(query.strip().lower()))


def half_up(value: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale


def gain_db(measured: Column, target: float, convert_only: bool = False) -> Column:
    """Decibels from the measured loudness to the target; 0 if unmeasured or only converting."""
    return F.lit(0.0) if convert_only else F.coalesce(F.lit(target) - measured, F.lit(0.0))


def signed_text(value: Column) -> Column:
    """P10: one decimal, with a plus sign above zero."""
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.1f", value))


def key_cell(key: Column, confident: Column) -> Column:
    """P10: the key, with a question mark when unsure."""
    return F.when(key.isNotNull(), F.concat(key, F.when(confident, "").otherwise("?"))).otherwise("")


def tempo_cell(bpm: Column, mode: Column) -> Column:
    """P10: the tempo, with a tilde when it changes."""
    return F.when(bpm.isNotNull(), F.concat(bpm.cast("string"), F.when(mode == "dynamic", "~").otherwise(""))).otherwise("")


def html_escape(text: Column) -> Column:
    """P10."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text
