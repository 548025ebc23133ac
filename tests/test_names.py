"""Names, genres and corrections against hand-derived values."""

from pyspark.sql import functions as F

from wavecrate.functions import fuzzy, genres, names
from wavecrate.operators import catalog, events
from wavecrate.sources import feedback


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


def test_cleanup(spark):
    cases = {
        "Artist_-_Title (Official Video)": ("Artist - Title", ["clean.underscores", "clean.mediaLabel"]),
        "Artist - Title [eu.hitmotop.com]": ("Artist - Title", ["clean.site"]),
        "Artist - Title - muzmo.ru": ("Artist - Title", ["clean.site"]),
        "muzofond.com - Artist - Title": ("Artist - Title", ["clean.site"]),
        "Artist - Title (320 kbps)": ("Artist - Title", ["clean.bitrate"]),
        "Artist - Title [mp3]": ("Artist - Title", ["clean.bitrate"]),
        "Artist - Title (клип)": ("Artist - Title", ["clean.mediaLabel"]),
        "Artist - Title 1234567": ("Artist - Title", ["clean.downloadId"]),
        "Artist - Title ()": ("Artist - Title", ["clean.leftovers"]),
        "Artist - Title (Live at Wembley)": ("Artist - Title (Live at Wembley)", []),
        "Artist - Title (Radio Edit)": ("Artist - Title (Radio Edit)", []),
        "Artist - 1999": ("Artist - 1999", []),
        "Artist - Title (320)": ("Artist - Title (320)", []),
        "___": ("___", []),
        "": ("", []),
    }
    got = column(spark, list(cases), lambda c: F.struct(*[x.alias(n) for x, n in zip(names.cleaned(c), ("t", "k"), strict=True)]))
    assert [(r["t"], r["k"]) for r in got] == list(cases.values())


def test_parse_and_paths(spark):
    got = column(spark, ["A_-_B 123456.mp3", "A – B", "A / B | C", "Only", ".hidden", "x.tar.GZ"], names.parsed)
    assert [(r["artist"], r["track"]) for r in got] == [("A", "B"), ("A", "B"), ("A / B", "C"), (None, "Only"), (None, ".hidden"), (None, "x.tar")]
    assert column(spark, ["a.MP3", ".x", "b", "c.d.Flac"], names.extension) == [".mp3", "", "", ".flac"]
    assert column(spark, ["Funky / Disco House", "x. ", "../../etc", "///", None], names.folder_name) == ["Funky & Disco House", "x", "....etc", "Unknown", "Unknown"]
    paths = spark.createDataFrame([(k, p) for k, p in enumerate(["a.mp3", "a.mp3", "a (2).mp3", "a.mp3", "b", "b"])], "k int, p string")
    assert [r.unique_path for r in catalog.unique_paths(paths, "p", "k").orderBy("k").collect()] == ["a.mp3", "a (2).mp3", "a (2) (2).mp3", "a (3).mp3", "b", "b (2)"]


def test_small_predicates(spark):
    assert column(spark, ["Voina i zhizn", "Two words", "война мир", "zh"], names.looks_transliterated) == [True, False, False, False]
    assert column(spark, ["1999-05", "199x", "2101", "", None], names.plausible_year) == [1999, None, None, None, None]
    assert column(spark, ['a+b "c"'], names.query_escape) == ['a\\+b \\"c\\"']
    assert column(spark, [-2.5, 2.345, -0.005], lambda c: names.half_up(c, 0), "double") == [-2.0, 2.0, 0.0]
    assert column(spark, ["#Seen Live", " House ", "", None], genres.is_not_a_genre) == [True, False, True, True]


def test_rules(spark):
    tags = ["hardcore", "hardcore punk", "rap hardcore", "uk hardcore", "jersey drill", "dub metal", "minimal tech house", "salsa"]
    assert column(spark, tags, lambda c: genres.classify(c, F.lit("Old"))) == ["Hardcore", "Rock", "Hip-Hop", "Hardcore", "Jersey Club", "Rock", "Tech House", "Old"]


def test_specific_pick(spark):
    tags = spark.createDataFrame([(1, 0, "pop", 9.0), (1, 1, "house", 5.0), (1, 2, "deep house", 1.0), (2, 0, "house", 100.0), (2, 1, "deep house", 1.0), (3, 0, "pop", None), (4, 0, "house", None), (4, 1, "deep house", None), (5, 0, "seen live", 1.0)], "i int, pos int, tag string, weight double")
    genre_map = spark.createDataFrame([("pop", "Pop"), ("house", "House"), ("deep house", "Deep House"), ("seen live", "House")], "tag string, genre string")
    got = catalog.specific_pick(tags, "i", [F.col("pos")], genre_map, genres.parents(spark)).orderBy("i").collect()
    assert [(r.i, r.genre) for r in got] == [(1, "Deep House"), (2, "House"), (3, "Pop"), (4, "Deep House")]


def test_transliteration():
    cyrillic = {"Voina": "Война", "Maika": "Майка", "Vypusknoi": "Выпускной", "Dai": "Дай", "Naiznanku": "Найзнанку", "Voina (club mix)": "Война (club mix)"}
    assert {k: fuzzy.to_cyrillic(k) for k in cyrillic} == cyrillic
    assert fuzzy.to_ascii("Щука Ёлка déjà") == "Shchuka Elka deja"


def test_similarity():
    assert fuzzy.ratio("", "") == 1 and fuzzy.ratio("a", "") == 0
    assert fuzzy.ratio("abcd", "bcde") == 0.75
    assert fuzzy.common_run(fuzzy.units("abxcd"), fuzzy.units("cdab")) == (0, 2, 2)
    assert fuzzy.similarity("Война", "Voina") == 1.0


def test_titles():
    assert fuzzy.split_title("Song (Extended Mix) feat. X") == ("Song", "(Extended Mix) (feat. X)")
    assert fuzzy.split_title("Song - Live Version") == ("Song", "(Live Version)")
    assert fuzzy.split_title("(Remix)") == ("(Remix)", "(Remix)")
    assert [fuzzy.remixer(t) for t in ("Song (The Someone Remix)", "Song (Extended Mix)", "Song")] == ["Someone", "", ""]
    assert fuzzy.merged_title("Song (Radio Edit)", "Song!") == "Song! (Radio Edit)"


def test_deliveries(spark):
    entry = '{"corrected": " House ", "bpm": 120, "title": "' + "x" * 600 + '"}'
    bodies = [entry, f"[{entry}]", "not json", "[" + ",".join(["{}"] * 201) + "]"]
    got = feedback.deliveries(spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")).orderBy("k").collect()
    assert [r.status for r in got] == [200, 200, 400, 413]
    rows = feedback.validated(spark.createDataFrame([e.asDict() for e in got[0].entries], feedback.ENTRY)).collect()
    assert rows[0].corrected == "House" and len(rows[0].title) == 500


def test_failure_limit(spark):
    rows = spark.createDataFrame([("a", k) for k in range(11)] + [("b", 5)], "ip string, at_s long")
    got = {(r.ip, r.at_s): r.retry_after for r in events.failure_window(rows, "ip", "at_s").collect()}
    assert got["a", 8] == 0 and got["a", 9] == 891 and got["b", 5] == 0


def test_names_are_cleaned_by_many_tasks(spark, tmp_path):
    """A table of one file and one group of rows is dealt over tasks by its rows; rules that don't apply leave a name as it is."""
    from wavecrate.plans import catalog_queries as C

    spark.range(25_000).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'old bolt' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = C.clean_names(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3 and found.count() == 25_000
    assert {r.cleaned for r in found.select("cleaned").distinct().collect()} == {"Brand#1 - old bolt", "Brand#1 - old bolt (Live)"}


def test_pairs_of_names_are_compared_once(spark, tmp_path):
    """Parts that repeat a pair of names share one comparison; names in ASCII have the form that the general way gives."""
    from wavecrate.plans import media_queries as M

    spark.range(12_000).selectExpr("id AS p_partkey", "concat('old bolt ', id % 2) AS p_name", "'Brand#1' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    rows = M.name_ratios(spark, str(tmp_path))
    assert rows.count() == 11_999 and rows.select("size", "sim").distinct().count() <= 2
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("ArrowEvalPython")], plan[plan.index("ArrowEvalPython") :]
    assert "Join" in above and "Aggregate [own" in below

    every = "".join(map(chr, range(128)))
    for text in (every, f" {every}", "A\x1c b!", "\x85", "(Ünï) Код"):
        assert fuzzy.compare_form(text) == fuzzy.trim("".join(c for c in text.lower() if fuzzy.unicodedata.category(c)[0] in "LN" or fuzzy.re.match(fuzzy.S, c)))
    calls, ratio = [], fuzzy.ratio
    fuzzy.ratio = lambda a, b: calls.append((a, b)) or ratio(a, b)
    try:
        assert fuzzy.similarity("old bolt", "new bolt") == ratio("old bolt", "new bolt") and len(calls) == 1
        assert fuzzy.similarity("Ёлка", "Elka") == 1 and len(calls) == 3
    finally:
        fuzzy.ratio = ratio
