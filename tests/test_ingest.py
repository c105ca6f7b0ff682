"""Landed pages, ranked lookups, issue scans, CSV round trip, unions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from driftlens.checks import ColumnContractError
from driftlens.sources import files as FS
from driftlens.sources.lookup import issue_lists, issue_scan, ranked_lookup, read_json_arrays
from driftlens.sources.paging import assemble_pages, read_landed_pages
from driftlens.sources.union import union_datasets

ROW_DDL = "text string, labels array<int>, id string"


def _land(tmp, sizes):
    """Write one envelope file per page; None = file without 'rows'."""
    d = os.path.join(tmp, "pages")
    os.makedirs(d, exist_ok=True)
    for p, n in enumerate(sizes):
        if n is None:
            doc = {"features": []}
        else:
            doc = {"rows": [{"row_idx": p * 100 + i,
                             "row": {"text": f"t{p}-{i}", "labels": [i % 28], "id": f"{p}-{i}"}}
                            for i in range(n)]}
        with open(os.path.join(d, f"page-{p:05d}.json"), "w") as f:
            json.dump(doc, f)
    return d


def test_pages_short_page_stops(spark, tmp_dir):
    rows = read_landed_pages(spark, _land(tmp_dir, [100, 100, 40, 100]), ROW_DDL)
    out = assemble_pages(rows, 100)
    assert out.count() == 240
    assert out.agg(F.max("row_index")).first()[0] == 239
    assert out.filter("page = 3").count() == 0
    first = out.orderBy("row_index").first()
    assert first.text == "t0-0" and first.labels == [0]


@pytest.mark.parametrize("sizes,expected", [
    ([100, 0, 100], 100),            # empty page stops
    ([100, None, 100], 100),         # page without 'rows' stops
    ([None, 100], 0),                # nothing on the first page
    ([100, 100, 100], 300),          # all full: runs out at the missing page
])
def test_pages_empty_or_missing(spark, tmp_dir, sizes, expected):
    rows = read_landed_pages(spark, _land(tmp_dir, sizes), ROW_DDL)
    assert assemble_pages(rows, 100).count() == expected


def test_pages_limit_not_multiple_of_page(spark, tmp_dir):
    rows = read_landed_pages(spark, _land(tmp_dir, [100, 100, 100]), ROW_DDL)
    out = assemble_pages(rows, 100, limit=150)
    assert out.count() == 150
    assert sorted(r.row_index for r in out.collect()) == list(range(150))


def test_pages_gap_in_numbering(spark):
    rows = spark.createDataFrame([(p, i) for p in (0, 1, 3) for i in range(10)], "page long, pos long")
    assert assemble_pages(rows, 10).count() == 20


def test_ranked_lookup(spark):
    ids = spark.createDataFrame([(0, 5), (1, 7), (2, 5), (3, 99), (4, 8), (5, 6), (6, 9)],
                                "pos long, id long")
    items = spark.createDataFrame(
        [(5, "A", "x"), (7, None, None), (8, " ", "\t"), (6, "T", None), (9, "late", "z")],
        "id long, title string, text string")
    out = ranked_lookup(ids, items, "id", ("pos",), limit=6)
    got = [(r.pos, r.id, r.text) for r in out.orderBy("pos").collect()]
    # duplicate id 5 kept twice, empty and unknown ids skipped, id 9 beyond limit
    assert got == [(0, 5, "A x"), (2, 5, "A x"), (5, 6, "T")]


def test_issue_scan(spark, tmp_dir):
    issues = [
        {"id": 1, "number": 10, "title": "Bug", "body": "It\n\nbreaks", "state": "open", "comments": 2,
         "user": {"login": "ann"}, "html_url": "u1"},
        {"id": 2, "number": 11, "title": "PR", "body": "x", "state": "open", "pull_request": {"url": "p"}},
        {"id": 3, "number": 12, "title": "PR2", "body": "y", "state": "open", "pull_request": None},
        {"id": 4, "number": 13, "title": "No user", "body": None, "state": "open", "user": None},
        {"id": 5, "number": 14, "title": "  ", "body": "\n", "state": "open"},
        {"id": 6, "number": 15, "title": "Closed", "body": "b", "state": "closed"},
        {"id": 7, "number": 16, "title": "Absent user", "state": "open"},
    ]
    path = os.path.join(tmp_dir, "issues.json")
    with open(path, "w") as f:
        json.dump(issues, f)
    with open(os.path.join(tmp_dir, "more.json"), "w") as f:
        json.dump([dict(issues[0], id=10 + i) for i in range(4)], f)
    lists = read_json_arrays(spark, os.path.join(tmp_dir, "*.json"))
    out = {r.id: r for r in issue_scan(issue_lists(lists)).collect()}
    assert sorted(out) == [1, 4, 7, 10, 11, 12, 13]
    assert out[1].text == "Bug\n\nIt\n\nbreaks" and out[1].user == "ann"
    assert out[4].user is None and out[4].text == "No user"
    assert out[7].user is None
    # the cap applies per list and before the pull-request filter
    capped = issue_scan(issue_lists(lists, per_page=3))
    assert sorted(r.id for r in capped.collect()) == [1, 10, 11, 12]
    bad = spark.createDataFrame([('[{"id": 1, "state": "open"}',)], "value string")
    with pytest.raises(Exception, match="(?i)malformed"):
        issue_scan(issue_lists(bad)).collect()


def test_damaged_page_fails(spark, tmp_dir):
    d = _land(tmp_dir, [10, 10, 10])
    with open(os.path.join(d, "page-00001.json"), "a") as f:
        f.write("x")
    with open(os.path.join(d, "page-00002.json"), "w") as f:
        f.write('{"rows": [{"row": {"text": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        assemble_pages(read_landed_pages(spark, d, ROW_DDL), 10).collect()


def test_page_file_without_number_fails(spark, tmp_dir):
    d = _land(tmp_dir, [10])
    os.rename(os.path.join(d, "page-00000.json"), os.path.join(d, "page.json"))
    with pytest.raises(Exception, match="no page number"):
        assemble_pages(read_landed_pages(spark, d, ROW_DDL), 10).collect()


def test_feeds_and_row_offset(spark):
    rows = [("a", p, i) for p in range(3) for i in range(10)] + [("b", 0, i) for i in range(10)]
    rows += [("b", 1, i) for i in range(4)] + [("b", 2, i) for i in range(10)] + [("c", 1, 0)]
    df = spark.createDataFrame(rows, "feed string, page long, pos long")
    got = {}
    for r in assemble_pages(df, 10, offset=5, limit=12, feed_cols=["feed"]).collect():
        got.setdefault(r.feed, []).append(r.row_index)
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(5, 17)), "b": list(range(5, 14))}
    assert assemble_pages(df.filter("feed = 'a'"), 10, offset=25).count() == 5


def test_csv_roundtrip_and_contract(spark, tmp_dir):
    rows = [(1, 'say "hi", ok', [1, 2]), (2, "line1\n\nline3", [27]), (3, "back\\slash", []),
            (4, "", [0]), (5, "NA", [3]), (6, "null", None), (7, "None", [4]), (8, "none", [5]),
            (9, " ", [6]), (10, None, [7])]
    df = spark.createDataFrame(rows, "id long, text string, labels array<int>")
    path = os.path.join(tmp_dir, "out.csv")
    FS.write_csv(df, path)
    back = FS.read_csv(spark, path, "id long, text string, labels string", required=["text", "labels"])
    got = {r.id: (r.text, r.labels) for r in back.collect()}
    assert len(got) == 10
    assert got[1] == ('say "hi", ok', "[1,2]")
    assert got[2][0] == "line1\n\nline3" and got[3][0] == "back\\slash"
    assert got[4][0] is None and got[5][0] is None and got[6][0] is None and got[7][0] is None
    assert got[8][0] == "none" and got[9][0] == " " and got[10][0] is None
    with pytest.raises(ColumnContractError, match="available columns"):
        FS.read_csv(spark, path, "id long, text string, labels string", required=["pred_label"])


def _csv(tmp, name, text):
    path = os.path.join(tmp, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_columns_are_mapped_by_name(spark, tmp_dir):
    path = _csv(tmp_dir, "a.csv", "labels,body,text,extra\n[27],b,hello,1\n")
    got = FS.read_csv(spark, path, "text string, labels string, note string", required=["text"])
    assert got.columns == ["text", "labels", "note"]
    assert tuple(got.first()) == ("hello", "[27]", None)
    with pytest.raises(ColumnContractError, match="body"):
        FS.read_csv(spark, _csv(tmp_dir, "b.csv", "labels,body\n[27],hello\n"), "text string, labels string", required=["text"])


@pytest.mark.parametrize("text", ["id,text\nabc,x\n", "id,text\n1,x,2\n", "id,text\n1\n"])
def test_csv_bad_rows_fail(spark, tmp_dir, text):
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        FS.read_csv(spark, _csv(tmp_dir, "c.csv", text), "id long, text string").collect()


def test_csv_files_with_other_headers_fail(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    _csv(d, "1.csv", "id,text\n1,x\n")
    _csv(d, "2.csv", "text,id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        FS.read_csv(spark, d, "id long, text string").collect()


def test_union_datasets_missing_columns(spark):
    a = spark.createDataFrame([(1, "x", "en")], "id long, text string, lang string")
    b = spark.createDataFrame([(2, "y", "user")], "id long, text string, role string")
    u = union_datasets({"indomain": a, "ood_a": b})
    got = {r.dataset: (r.lang, r.role) for r in u.collect()}
    assert got == {"indomain": ("en", None), "ood_a": (None, "user")}


def test_parquet_sink_partitioned(spark, tmp_dir):
    df = spark.createDataFrame([(1, "indomain"), (2, "ood_a")], "id long, dataset string")
    path = os.path.join(tmp_dir, "p")
    FS.write_parquet(df, path, partition_by=["dataset"])
    FS.write_parquet(df, path, partition_by=["dataset"])   # idempotent overwrite
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.filter("dataset = 'ood_a'").first().id == 2
