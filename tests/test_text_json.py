"""Strip, compose, NA tokens, JSON key presence and projection."""

from pyspark.sql import functions as F

from driftlens.constants import NA_TOKENS, WHITESPACE
from driftlens.functions.jsonx import has_key
from driftlens.functions.text import compose, strip_ws
from driftlens.operators import clean as C


def test_whitespace_set_is_python_isspace():
    assert len(WHITESPACE) == 29
    assert all(c.isspace() for c in WHITESPACE)
    assert {chr(i) for i in range(0x3001) if chr(i).isspace()} == set(WHITESPACE)


def test_strip_matches_python(spark):
    samples = [WHITESPACE + "a b" + WHITESPACE, " x ", "  ", "", "x\n\ny", None]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(strip_ws("s")).collect()]
    assert got == [None if s is None else s.strip() for s in samples]


def test_compose_and_drop_empty(spark):
    df = spark.createDataFrame([("T", "b"), (None, "b"), ("T", None), (None, None), (" ", "\n"),
                                ("t ", " x")], "title string, body string")
    out = C.compose_text(df, "title", "body", "\n\n")
    got = [r.text for r in out.collect()]
    exp = [((t or "") + "\n\n" + (b or "")).strip() for t, b in
           [("T", "b"), (None, "b"), ("T", None), (None, None), (" ", "\n"), ("t ", " x")]]
    assert got == exp
    assert C.drop_empty_text(out).count() == sum(1 for e in exp if e)


def test_na_tokens(spark):
    vals = ["NA", "null", "None", "nan", "NULL", "n/a", "", " ", "none", "text", None]
    df = spark.createDataFrame([(v,) for v in vals], "text string")
    got = [r.text for r in C.recognise_na(df, ["text"]).collect()]
    assert got == [None if (v is None or v in NA_TOKENS) else v for v in vals]
    assert got[7] == " " and got[8] == "none"
    filled = [r.text for r in C.fill_missing_text(C.recognise_na(df, ["text"])).collect()]
    assert filled.count("") == 8


def test_key_presence_includes_json_null(spark):
    objs = ['{"a": 1, "pull_request": null}', '{"a": 1, "pull_request": {"u": 1}}',
            '{"a": 1}', '{"pull_requests": 1}', "not json", None]
    df = spark.createDataFrame([(o,) for o in objs], "j string")
    got = [r[0] for r in df.select(has_key("j", "pull_request")).collect()]
    assert got == [True, True, False, False, False, False]
    # get_json_object cannot see a null-valued key:
    assert df.select(F.get_json_object("j", "$.pull_request")).first()[0] is None


def test_json_projection_missing_fields(spark):
    df = spark.createDataFrame([('{"k": 3}',), ('{}',), ('{"k": 4, "q": "x"}',)], "props string")
    out = C.project_json(df, "props", "k long, q string").collect()
    assert [(r.k, r.q) for r in out] == [(3, None), (None, None), (4, "x")]


def test_drop_missing(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "text string, label int")
    assert C.drop_missing(df, ["text", "label"]).count() == 1
