import random
import re

import numpy as np

from themeloom.operators import bad_rows as B

SCHEMA = "raw_id bigint, file_name string, layout string, raw string, loaded_at timestamp, values string"
GOOD = 'Year: 2001\nTitle: A: b\nlink : http://x.example/1\nABSTRACT: "quoted"\nkeywords:\nauthor: Ann Lee\n'


def parsed(spark, rows):
    df = spark.createDataFrame([(i, "vis_1.txt", layout, raw, None, "clash") for i, (layout, raw) in enumerate(rows)], SCHEMA)
    return {r["raw_id"]: r for r in B.parse_records(df).collect()}


def slow_states(classes):
    state, out = B.C_START, []
    for c in classes:
        out.append(state)
        state = B.TRANSITIONS[state, c]
    return out


def test_chunks_compose_to_the_serial_states():
    rng = np.random.default_rng(1)
    for n in (1, 5, 127, 128, 129, 1000):
        classes = rng.integers(0, B.N_CLASSES, n).astype(np.uint8)
        for chunk in (1, 7, 128):
            assert B.states_before(classes, chunk).tolist() == slow_states(classes)


def csv_reason(raw):
    """Brute force by regular expression."""
    if not re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\n]*))*', raw):
        return "quoting"
    return None if len(re.findall(r'(?:^|,)(?:"(?:[^"]|"")*"|[^",]*)', raw)) == 6 else "columns"


def test_csv_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        fields = ["1999", "t", "l", "a", "k", "au"]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(6)
            fields[i] = rng.choice(['"q"', '"a,b"', '"a""b"', 'x"y', '"open', '"x"y', "", "a,b", "é" * 40])
        rows.append(("csv", ",".join(fields)))
    got = parsed(spark, rows)
    for i, (_, raw) in enumerate(rows):
        want = csv_reason(raw)
        assert (got[i]["reason"] if got[i]["reason"] in ("quoting", "columns") else None) == want, raw


def test_reasons(spark):
    rows = [
        ("labelled", GOOD), ("labelled", GOOD + "----\n\n"), ("labelled", GOOD.replace("\n", "\r\n")), ("labelled", GOOD + "a\nb"), ("labelled", GOOD + "a: b"),
        ("labelled", GOOD.replace('"quoted"', '"quoted')), ("labelled", GOOD.replace('"quoted"', '"')), ("labelled", GOOD.replace("2001", "20O1")), ("labelled", GOOD.replace("2001", "1949")),
        ("labelled", GOOD.replace("Ann Lee", "\x07Ann")), ("labelled", GOOD.replace("A: b", "...")), ("labelled", GOOD.replace("Title", "Titel")), ("labelled", None), ("labelled", ""), (None, GOOD), ("xml", GOOD),
        ("csv", '2001,"say ""x""",http://y,abc,"k, l",A B\n'), ("csv", "2001,t,l,a,k"), ("csv", '"2001,t,l,a,k,z'), ("csv", "2001,t,l,a�,k,z"), ("csv", "2001,t,l," + "a" * 300_000 + ",k,z"),
    ]
    got = parsed(spark, rows)
    want = [None, None, None, "columns", "columns", "quoting", "quoting", "year", "year", "author", "title", "columns", "columns", "columns", "columns", "columns", None, "columns", "quoting", "abstract", None]
    assert [got[i]["reason"] for i in range(len(rows))] == want
    assert got[0]["title"] == "A: b" and got[0]["link"] == "link : http://x.example/1" and got[0]["uri"] == "http_//x.example/1_"
    assert got[16]["title"] == 'say "x"' and got[16]["keywords"] == "k, l" and got[16]["conf_name"] == "vis"
    assert got[18]["fault_at"] == len("\"2001,t,l,a,k,z") and len(got[20]["abstract"]) == 300_000


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.rejected_records(empty).count() == 0 and B.valid_records(empty).count() == 0
    df = spark.createDataFrame([(1, "v", "csv", "x", None, "")] * 2, SCHEMA)
    assert B.rejected_records(df).count() == 2


def test_offsets_of_faults(spark, monkeypatch):
    monkeypatch.setattr(B, "PORTION", 40)
    rows = [
        ("labelled", GOOD.replace("2001", "20O1")), ("labelled", GOOD.replace("Title", "Titel")), ("labelled", GOOD + "a: b"), ("labelled", GOOD + "--\n\nmore"), ("labelled", "Year: 2001\nTitle: x"),
        ("csv", "2001,t,l,a,k"), ("csv", "2001,t,l,a,k,z,more"), ("csv", "2001,t,l,\x07,k,z"), ("csv", "20 1,t,l,a,k,z"), (None, GOOD), ("labelled", None),
    ]
    got = parsed(spark, rows)
    text = lambda i: rows[i][1]
    want = [5, text(1).index("Titel"), len(GOOD), text(3).index("more"), len(text(4)), len(text(5)), text(6).index("more"), text(7).index("\x07"), 0, 0, 0]
    assert [got[i]["fault_at"] for i in range(len(rows))] == want
