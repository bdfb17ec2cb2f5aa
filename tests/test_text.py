import pytest
from pyspark.sql import functions as F

from kindred.functions import credits as C
from kindred.functions import display as D
from kindred.functions import similarity as S
from kindred.functions import text as X
from kindred.options import AGGRESSIVE, DJ_LIBRARY, MINIMAL, NormalisationOptions
from kindred.plans.normalise import normalise


def values(spark, expression, inputs):
    """The expression over many inputs in one job."""
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r.v for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


TABLES = {
    "collapse": (X.collapse, [("  a \t b\n", "a b"), ("x  y", "x y"), ("", ""), ("　", "")]),
    "unify": (X.unify_punctuation, [("1 – 2 — 3", "1 - 2 - 3"), ("it’s ‘so’", "it's 'so'"), ("«q» „r“", '"q" "r"')]),
    "diacritics": (X.fold_diacritics, [("Žižkov", "Zizkov"), ("Ærøskøbing", "AEroskobing"), ("Łódź", "Lodz"), ("été", "ete"), ("ＡＢＣ１", "ABC1"), ("Þór", "Thor"), ("plain", "plain"), ("Ελλάς", "Ελλας")]),
    "ampersand": (X.ampersand_to_and, [("Tom & Jerry", "Tom and Jerry"), ("& &", "and and"), ("A+B", "A+B"), ("x + y", "x and y")]),
    "strip": (X.strip_punctuation, [("St. John's", "St Johns"), ("a-b/c", "a b c"), ("½ & Ⅷ!", "½ Ⅷ"), ("é!", "é")]),
    "the": (X.remove_the, [("The Band", "Band"), ("THE X", "X"), ("Band, The", "Band"), ("The", "The"), ("Then", "Then"), (", the", ", the")]),
    "search": (X.search_fold, [("CafÉ Ørsted", "cafe ørsted")]),
    "trim": (X.trim_separators, [(" - a b -_.", "a b"), (":|/", ""), ("a-b", "a-b")]),
    "number": (X.leading_number, [("7/12", 7), (" 08", 8), ("0", None), ("B2", None), ("99999999999", None)]),
    "year": (X.year, [("1999-02-03", 1999), ("03/02/1999", 1999), ("199", None), ("20051231", 2005)]),
    "track number": (C.remove_track_number, [
        ("03 - Tune", "Tune"), ("3. Tune", "Tune"), ("3) Tune", "Tune"), ("03_Tune", "Tune"), ("2-03 Tune", "Tune"), ("03 Tune", "Tune"), ("3 — Tune", "Tune"), ("03 -Tune", "Tune"),
        ("50 Ways", "50 Ways"), ("3 Days", "3 Days"), ("2001", "2001"), ("1-2-3-4 Go", "1-2-3-4 Go"), ("03 - 04", "03 - 04"), ("1234 Tune", "1234 Tune"),
    ]),
    "version": (C.version_class, [
        ("Original Version", "neutral"), ("1998 Remastered", "neutral"), ('7" Edit', "neutral"), ("Re-Mastered", "neutral"), ("Joe's Re-Edit", "distinct"), ("Somebody Mix", "distinct"),
        ("Live in Rome", "distinct"), ("VIP", "distinct"), ("Part 3", "not_a_version"), ("A The", "not_a_version"), ("", "not_a_version"),
    ]),
}


@pytest.mark.parametrize("name", TABLES)
def test_tables(spark, name):
    expression, rows = TABLES[name]
    assert values(spark, expression, [r[0] for r in rows]) == [r[1] for r in rows]


def test_arrays(spark):
    assert values(spark, X.split_spaced_dash, ["a – b - c", "a-b", " - x", "a - - b", ""]) == [["a", "b", "c"], ["a-b"], ["", "x"], ["a", "", "b"], [""]]
    names = {"P & Q, R": ["P", "Q", "R"], "P and Q": ["P", "Q"], "King X": ["King X"], "& P": ["& P"], "P & , Q": ["P", "Q"], "AC/DC": ["AC/DC"], "P /": ["P"], "": [], "P vs. Q with R": ["P", "Q", "R"], "x": ["x"]}
    assert values(spark, C.split_collaborators, list(names)) == list(names.values())
    segments = lambda c: F.transform(C.bracket_segments(c), lambda x: C.segment_text(c, x))
    cases = {"a (b [c] d) {e}": ["b [c] d", "e"], "a (b] c)": ["b] c"], "a ( b [c]": [], "(x) (": ["x"], "none": [], "😀 (é)": ["é"], ")(a)(": ["a"]}
    assert values(spark, segments, list(cases)) == list(cases.values())
    assert values(spark, lambda c: C.without_segments(c, C.bracket_segments(c)), ["a (b)  c [d]", "a  b"]) == ["a c", "a  b"]


def test_featured(spark):
    cases = {
        "P ft. Q": ("P", "Q"), "P Featuring Q & R": ("P", "Q & R"), "P [feat. Q] (Edit)": ("P (Edit)", "Q"), "P feat: Q (Edit)": ("P (Edit)", "Q"),
        "Ft Knox": ("Ft Knox", None), "Soft Feet": ("Soft Feet", None), "P ft.": ("P", None), "P (ft. Q": ("P", "Q"), "P featuring. Q": ("P featuring. Q", None),
    }
    assert [(r["main"], r["featured"]) for r in values(spark, C.split_featured, list(cases))] == list(cases.values())


def normalised(spark, options, *rows):
    frame = spark.createDataFrame([(i, t, a, p) for i, (t, a, p) in enumerate((*r, None)[:3] for r in rows)], "i int, title string, artist string, stem string")
    stem = F.col("stem") if options.filename_fallback else None
    return [(n.title, n.primary, n.featured, n.removed) for n, in normalise(frame, options, stem=stem).orderBy("i").select("n").collect()]


def test_normalise(spark):
    assert normalised(spark, MINIMAL, ("  A  Tune (Original Mix) ", "P ft. Q")) == [("a tune (original mix)", ["p ft. q"], [], [])]
    dj = normalised(
        spark, DJ_LIBRARY, ("Tune (Original Mix)", "The P ft. Q"), ("Tune (Somebody Remix)", "P"), ("04 - Tune (feat. Q) [Radio Edit]", "R & P"), ("P - Tune", "P"), ("P - Tune", ""),
        ("Tune – Remastered 2011", "P"), ("(Original Mix)", "P"), ("Tune - Part 2", "P"), ("Tune (Part 2) (Extended Mix)", "P"),
    )
    assert dj == [
        ("tune", ["p"], ["q"], ["Original Mix"]), ("tune (somebody remix)", ["p"], [], []), ("tune", ["p", "r"], ["q"], ["04", "feat. Q", "Radio Edit"]), ("tune", ["p"], [], []), ("tune", ["p"], [], []),
        ("tune", ["p"], [], ["Remastered 2011"]), ("(original mix)", ["p"], [], []), ("tune - part 2", ["p"], [], []), ("tune (part 2)", ["p"], [], ["Extended Mix"]),
    ]
    assert normalised(spark, AGGRESSIVE, ("Tune (Some Remix) - Live", "P"), ("", "", "05 - P & Q - Tune!"), ("", "Z", "P - Tune")) == [
        ("tune", ["p"], [], ["Some Remix", "Live"]), ("tune", ["p", "q"], [], []), ("tune", ["z"], [], []),
    ]
    assert normalised(spark, NormalisationOptions(strip_all_brackets=True, ignore_spaces=True, ignore_case=False), ("A Tune [x] (y)", "P Q")) == [("ATune", ["PQ"], [], ["x", "y"])]


def test_similarity(spark):
    pairs = [("kitten", "sitting"), ("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("b a", "a b"), ("", "x"), ("é", "e")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(S.levenshtein_ratio(a, b).alias("l"), S.jaro_winkler(a, b).alias("j"), S.token_sort_ratio(a, b).alias("t"), S.levenshtein_ratio(a, b, 0.5).alias("bound")).collect()
    assert got[0].l == pytest.approx(1 - 3 / 7) and got[1].j == pytest.approx(0.9611, abs=1e-3) and got[2].j == pytest.approx(0.8133, abs=1e-3)
    assert got[3].t == 1 and got[4].l == 0 and got[5].l == 0 and got[0].bound == pytest.approx(4 / 7) and got[4].bound is None


def test_display(spark):
    n = lambda c: c.cast("double")
    assert values(spark, lambda c: D.format_duration(n(c)), ["59.5", "3600", "3725", "0.4"]) == ["1:00", "1:00:00", "1:02:05", "0:00"]
    assert values(spark, lambda c: D.format_sample_rate(c.cast("int")), ["44100", "48000", "11025"]) == ["44.1 kHz", "48 kHz", "11.0 kHz"]
    assert values(spark, lambda c: D.format_size(c.cast("long")), ["999", "1500", "8250000", "999999", "12345678901", "5000000000000"]) == ["999 bytes", "2 KB", "8.2 MB", "1000 KB", "12.35 GB", "5.00 TB"]
    assert values(spark, lambda c: D.name_list(F.split(c, ",")), ["a", "a,b", "a,b,c", "a,b,c,d,e"]) == ["“a”", "“a” and “b”", "“a”, “b” and “c”", "“a”, “b”, “c” and 2 more"]
    order = values(spark, X.natural_key, ["track 10", "Track 2", "Träck 3", "track 002"])
    assert sorted(range(4), key=lambda i: order[i]) in ([1, 3, 2, 0], [3, 1, 2, 0])
    long = values(spark, X.natural_key, ["t " + "9" * 25, "t 1" + "0" * 25, "t " + "0" * 30 + "1"])
    assert long[2] < long[0] < long[1]
    keys = values(spark, D.version_key, ["1.10", "1.9", "1.2", "1.2.0"])
    assert keys[0] > keys[1] and keys[2] == keys[3]
    assert values(spark, lambda c: F.concat_ws("|", D.file_name(c), D.file_stem(c)), ["/a/b.c.mp3", "/a/.x", "/a/n"]) == ["b.c.mp3|b.c", ".x|.x", "n|n"]
    assert D.parse_column("tag:") is None and D.parse_column("tag:KEY") == "tag:KEY" and D.parse_column("size") == "size" and D.parse_column("what") is None
