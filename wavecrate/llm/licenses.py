"""Licence scans with a positional index of rare licence words, in DataFrame operations only.

The templates below are notices and short texts of public licences, each with mandatory key phrases; the first of them is
its anchor. Document frequencies of the anchors' words are counted over the whole corpus; of each anchor the RARE words
with the highest inverse document frequency are indexed with their positions (the postings). A file's words are looked up
in the index: the rarest word at place p with a posting (template, q) proposes that the template starts at p - q. Where
all postings of the template agree on that start, the key phrases are verified: the anchor in its place, the others
within SLACK words of theirs and a tenth of their distance from the anchor, as names and dates in between differ. The score is the largest share
of a template's words that stand in their places.

As every word of an anchor stands wherever the anchor does, each verified place is proposed whichever of its words are
the rare ones: the corpus steers the cost of the search, never its result. A base phrase is a template that is its own
anchor.

Defined results: null and empty texts have no words and labels; repeated places count each; labels are sorted and
distinct, an empty string if there is none; repeated rows get equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE, SLACK = 3, 3

# Base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Label, notice, and the key phrases that must stand in it, the anchor first.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied", ("this permission notice shall be included in all copies or substantial portions of the software",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("unless required by applicable law or agreed to in writing", "governing permissions and limitations under the license")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "under the terms of the gnu library general public license", ("gnu library general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising from the use of this software",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely")),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("eupl", "licensed under the european union public licence", ("european union public licence",)),
    ("artistic-2", "distributed under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc", "licensed under a creative commons attribution non commercial 4 0 international license", ("creative commons attribution non commercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)


def templates() -> list[tuple[str, bool, list[str], list[tuple[int, list[str]]]]]:
    """Label, whether it is a base phrase, words, and key phrases with their places."""
    out = [(label, True, phrase.split(), [(0, phrase.split())]) for label, phrase in BASE]
    for label, notice, keys in NOTICES:
        words = notice.split()
        places = []
        for key in keys:
            k = key.split()
            places.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        out.append((label, False, words, places))
    return out


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rare_words(docs: DataFrame, rare: int = RARE) -> list[list[str]]:
    """The indexed words of each template, rarest first: those of its anchor that stand in the fewest documents of docs, ties by word."""
    anchors = [keys[0][1] for _, _, _, keys in templates()]
    vocabulary = sorted({w for words in anchors for w in words})
    text = F.coalesce("text", F.lit(""))
    own = F.array_intersect(F.regexp_extract_all(lowered(text), F.lit(WORD), 0), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # at most one row per template word
    return [sorted(set(words), key=lambda w: (found.get(w, 0), w))[:rare] for words in anchors]


def scan(docs: DataFrame, rare: list[list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    rare: words of each template's anchor, the first of which proposes; chosen from the corpus if not given.
    """
    index = rare if rare is not None else rare_words(docs)
    known = templates()
    anchored = lambda t: range(known[t][3][0][0], known[t][3][0][0] + len(known[t][3][0][1]))
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, chosen in enumerate(index):
        for q in anchored(t):
            if known[t][2][q] == chosen[0]:
                postings.setdefault(chosen[0], []).append((t, q))
    posting = lambda t, q: F.struct(F.lit(t).alias("t"), F.lit(q).alias("q"))
    mark = lambda w, q: F.struct(F.lit(w).alias("w"), F.lit(q).alias("q"))
    where = F.create_map(*[c for w, own in postings.items() for c in (F.lit(w), F.array(*[posting(*p) for p in own]))])
    marks = F.array(*[F.array(*[mark(known[t][2][q], q) for q in anchored(t) if known[t][2][q] in chosen]) for t, chosen in enumerate(index)])
    spelt = F.array(*[F.array(*[mark(w, q) for q, w in enumerate(words)]) for _, _, words, _ in known])
    slack = lambda places, q: 0 if q == places[0][0] else SLACK + abs(q - places[0][0]) // 10
    key = lambda places, q, k: F.struct(F.lit(q).alias("q"), F.lit(slack(places, q)).alias("slack"), F.array(*map(F.lit, k)).alias("words"))
    keys = F.array(*[F.array(*[key(places, q, k) for q, k in places]) for _, _, _, places in known])
    base = F.array(*[F.lit(b) for _, b, _, _ in known])
    label = F.array(*[F.lit(x) for x, _, _, _ in known])

    text = F.coalesce("text", F.lit(""))
    # Only texts in which some proposing word stands are cut into words.
    letter = ANY_CASE_WORD[:-1]
    any_rare = f"(?i)(?<!{letter})(?:{'|'.join(sorted(map(re.escape, postings)))})(?!{letter})"
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.when(text.rlike(any_rare), text).otherwise("").alias("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all(lowered(F.col("__text")), F.lit(WORD), 0)).drop("__text")
    nothing = F.array().cast("array<struct<t:int,q:int>>")
    # Few words propose: those are found by a set first, and only they are looked up in the postings.
    hits = F.array_compact(F.transform("__words", lambda w, p: F.when(w.isin(*postings), F.struct(w.alias("w"), p.alias("p")))))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.coalesce(F.try_element_at(where, h["w"]), nothing), lambda x: F.struct(x["t"].alias("t"), (h["p"] - x["q"]).alias("start")))))
    rows = rows.withColumn("__starts", F.array_distinct(starts))
    words = F.col("__words")

    def stands(x: Column, m: Column) -> Column:
        return F.coalesce(F.get(words, x["start"] + m["q"]) == m["w"], F.lit(False))

    def phrase_at(at: Column, phrase: Column) -> Column:
        return F.when(at >= 0, F.slice(words, at + 1, F.size(phrase)) == phrase).otherwise(False)

    def verified(x: Column) -> Column:
        return F.forall(F.get(keys, x["t"]), lambda k: F.exists(F.sequence(-k["slack"], k["slack"]), lambda d: phrase_at(x["start"] + k["q"] + d, k["words"])))

    def share(x: Column) -> Column:
        own = F.get(spelt, x["t"])
        return F.size(F.filter(own, lambda m: stands(x, m))) / F.size(own)

    # The intersection of a template's postings by relative position; then the key phrases.
    rows = rows.withColumn("__agreed", F.filter("__starts", lambda x: F.forall(F.get(marks, x["t"]), lambda m: stands(x, m))))
    rows = rows.withColumn("__found", F.filter("__agreed", verified))
    rows = rows.withColumn("__base", F.filter("__found", lambda x: F.get(base, x["t"])))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label, x["t"])))), ",")
    places = F.transform("__base", lambda x: x["start"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names("__base").alias("base_labels"),
        names("__found").alias("labels"),
        F.coalesce(F.array_max(F.transform("__found", share)), F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}


def _oracle() -> str:
    """DuckDB: every template is looked for at every place of every text where its anchor's first word stands."""
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    anchors = ", ".join(f"({t}, '{label}', {base}, {places[0][0]}, {text(places[0][1])}, {text(words)})" for t, (label, base, words, places) in enumerate(templates()))
    others = ", ".join(f"({t}, {q - places[0][0]}, {SLACK + abs(q - places[0][0]) // 10}, {text(k)})" for t, (*_, places) in enumerate(templates()) for q, k in places[1:])
    some = lambda which: f"coalesce(string_agg(DISTINCT label, ',' ORDER BY label){which}, '')"
    return f"""
        WITH w AS (SELECT row_number() OVER () AS own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
        a(t, label, base, shift, anchor, spelt) AS (VALUES {anchors}), k(t, away, slack, words) AS (VALUES {others}),
        p AS (SELECT own, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
        c AS (SELECT own, i, a.* FROM p JOIN a ON word = anchor[1]),
        f AS (SELECT row_number() OVER () AS place, c.*, ws FROM c JOIN w USING (own) WHERE ws[i + 1:i + len(anchor)] = anchor),
        n AS (SELECT place, bool_and(len([d for d in range(-slack, slack + 1) if i + away + d >= 0 AND ws[i + away + d + 1:i + away + d + len(words)] = words]) > 0) AS near FROM f JOIN k USING (t) GROUP BY place),
        g AS (SELECT own, i, label, base, list_sum([CAST(i - shift + q >= 0 AND coalesce(ws[i - shift + q + 1] = spelt[q + 1], false) AS INTEGER) for q in range(len(spelt))]) / len(spelt)::DOUBLE AS share
              FROM f LEFT JOIN n USING (place) WHERE coalesce(near, true)),
        s AS (SELECT own, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, {some(' FILTER (base)')} AS base_labels, {some('')} AS labels, max(share) AS score FROM g GROUP BY own)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
        FROM w LEFT JOIN s USING (own)"""


ORACLE = {"op3_license_scan": _oracle()}
