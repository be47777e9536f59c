import pytest

from themeloom.operators import multivalue as M

SCHEMA = "rec_id bigint, keywords string, author string, loaded_at int, field string"
CASES = [
    ("a, b ,c", ["a", "b", "c"]), ("search & rescue / k-means", ["search & rescue", "k-means"]), ("time/space; what-if -- x", ["time/space", "what-if", "x"]), ('"a; b"; "the ""wall"" x"', ["a; b", 'the "wall" x']),
    ("a;;b; ;", ["a", "b"]), ("x\ty\nz", ["x", "y", "z"]), ("a · b·c", ["a", "b", "c"]), ('14" wide, b', ['14" wide', "b"]), ("", []), ("   ", []), ("one", ["one"]), ("a, a", ["a", "a"]), ('"', ['"']), ('say "x, y" now, z', ['say "x, y" now', "z"]),
]
NAMES = [
    ("Lee, Ann; Bo Ray and Cy Fox", ["Lee, Ann", "Bo Ray", "Cy Fox"]), ("Ann Lee, Bo Ray & Cy Fox,", ["Ann Lee", "Bo Ray", "Cy Fox"]), ("van Dyke, A. B. / Cy Fox", ["van Dyke, A. B.", "Cy Fox"]), ("D. Fox, Bo Ray", ["D. Fox", "Bo Ray"]),
    ('"Institute for X, Rome" and Ann Lee', ["Institute for X, Rome", "Ann Lee"]), ("Lee, Ann, Ray, Bo", ["Lee, Ann", "Ray, Bo"]), ("Ann Lee and , Bo Ray", ["Ann Lee", "Bo Ray"]), ("Lee, A.", ["Lee, A."]), ("Sand Lee", ["Sand Lee"]),
]


def test_values(spark):
    rows = [(i, k, None, 1, "clash") for i, (k, _) in enumerate(CASES)] + [(100 + i, None, a, 1, "") for i, (a, _) in enumerate(NAMES)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in M.explode_values(df, "rec_id", {"keywords": M.KEYWORDS, "author": M.AUTHORS}).orderBy("rec_id", "pos").collect():
        got.setdefault(r["rec_id"], []).append((r["pos"], r["val"]))
    for i, want in [(i, w) for i, (_, w) in enumerate(CASES)] + [(100 + i, w) for i, (_, w) in enumerate(NAMES)]:
        assert got.get(i, []) == list(enumerate(want, 1)), i


@pytest.mark.parametrize("text,n", [('"' + "x" * 200_000 + '", b', 2), ("ab;" * 50_000, 50_000)])
def test_long_fields(spark, text, n):
    df = spark.createDataFrame([(1, text, text, 1, "")], SCHEMA)
    got = {r["field"]: r["n"] for r in M.explode_values(df, "rec_id", {"keywords": M.KEYWORDS, "author": M.AUTHORS}).groupBy("field").count().withColumnRenamed("count", "n").collect()}
    assert got == {"keywords": n, "author": n}


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "old", None, 1, ""), (1, "new", "x", 2, ""), (1, "new", "x", 2, "")], SCHEMA)
    assert [tuple(r) for r in M.latest_delivery(df, "rec_id", ["keywords", "author"]).collect()] == [(1, "new", "x")]
    assert M.explode_values(df.limit(0), "rec_id", {"keywords": M.KEYWORDS}).count() == 0
