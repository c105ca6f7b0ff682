"""Page source, CSV quarantine, streaming reports."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from driftlens.checks import ColumnContractError
from driftlens.sources import files as FS
from driftlens.sources import page_source as PS
from driftlens.sources.paging import assemble_pages, read_landed_pages
from driftlens.streaming import reports as R

DDL = "id long, text string, score double, ok boolean"


def land(path, number, rows, name="page-{:05d}.json"):
    os.makedirs(path, exist_ok=True)
    tmp = os.path.join(path, f".{number}.tmp")
    with open(tmp, "w") as f:
        json.dump({"rows": [{"row": r} for r in rows]}, f)
    os.rename(tmp, os.path.join(path, name.format(number)))


def row(i):
    return {"id": i, "text": f"text \n \"{i}\" é", "score": i / 4, "ok": i % 2 == 0} | ({"extra": [1]} if i % 3 else {})


def land_feed(path, sizes, page_size=10):
    for n, k in enumerate(sizes):
        if k is not None:
            land(path, n, [row(n * page_size + i) for i in range(k)])


def rows_of(df):
    return sorted(map(tuple, df.select("row_index", "page", "pos", "id", "text", "score", "ok").collect()))


# ---- page source ---------------------------------------------------------------------------

@pytest.mark.parametrize("sizes", [[10, 10, 4], [10, 3, 10], [10, None, 10], [10, 0, 10], [None, 10], [0], [10] * 5])
@pytest.mark.parametrize("limit,offset", [(None, 0), (13, 0), (None, 12), (7, 15), (0, 0)])
def test_page_source_equals_page_assembly(spark, tmp_dir, sizes, limit, offset):
    land_feed(f"{tmp_dir}/p", sizes)
    land(f"{tmp_dir}/p", 999, [row(5)])
    want = assemble_pages(read_landed_pages(spark, f"{tmp_dir}/p", DDL), 10, limit, offset)
    got = PS.read_pages(spark, f"{tmp_dir}/p", DDL, 10, limit, offset)
    assert got.columns == ["page", "pos", "id", "text", "score", "ok", "row_index"]
    assert rows_of(got) == rows_of(want)


def test_only_needed_pages_are_opened(spark, tmp_dir):
    land_feed(f"{tmp_dir}/p", [10] * 8)
    with open(f"{tmp_dir}/p/page-00006.json", "w") as f:
        f.write("{damaged")
    assert len(rows_of(PS.read_pages(spark, f"{tmp_dir}/p", DDL, 10, limit=25, offset=12))) == 25
    with pytest.raises(Exception, match="damaged page"):
        PS.read_pages(spark, f"{tmp_dir}/p", DDL, 10).collect()
    pages = PS.run_of_pages(PS.list_pages(f"{tmp_dir}/p"), 1, 3)
    assert [p.number for p in pages] == [1, 2, 3]


def test_page_values_must_fit(spark, tmp_dir):
    land(f"{tmp_dir}/a", 0, [{"id": None, "text": 5, "score": 1, "ok": None}, {}])
    got = PS.read_pages(spark, f"{tmp_dir}/a", DDL, 10).select("id", "text", "score", "ok").collect()
    assert [tuple(r) for r in got] == [(None, "5", 1.0, None), (None, None, None, None)]
    for bad in ({"id": "x"}, {"id": True}, {"score": "1"}, {"ok": 1}):
        land(f"{tmp_dir}/b", 0, [bad])
        with pytest.raises(Exception, match="is no"):
            PS.read_pages(spark, f"{tmp_dir}/b", DDL, 10).collect()
    land(f"{tmp_dir}/c", 0, [row(1)], name="none.json")
    with pytest.raises(Exception, match="no page number"):
        PS.read_pages(spark, f"{tmp_dir}/c", DDL, 10).collect()


def test_page_stream_reads_what_lands_between_triggers(spark, tmp_dir):
    path, out = f"{tmp_dir}/p", f"{tmp_dir}/out"

    def trigger():
        q = (PS.stream_pages(spark, path, DDL).writeStream.format("parquet").option("checkpointLocation", f"{tmp_dir}/ck")
             .option("path", out).trigger(availableNow=True).start())
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((r.page, r.pos, r.id) for r in spark.read.parquet(out).collect())

    def want(*pages):
        return sorted((n, i, n * 10 + i) for n in pages for i in range(10))

    land_feed(path, [10, 10])
    assert trigger() == want(0, 1)
    assert trigger() == want(0, 1)
    land_feed(path, [None, None, None, 10, 10])   # a gap: page 2 is missing
    assert trigger() == want(0, 1)
    land_feed(path, [None, None, 10])
    assert trigger() == want(0, 1, 2, 3, 4)


# ---- quarantine ----------------------------------------------------------------------------

def test_quarantine_splits_rows_and_rejects(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write('id,text,n\n1,"a\n""b""",5\n2,c,five\n3,d\n4,e,6,7\n,f,8\n6,NA,9\nx,NA,1\n7,"g, h",\n')
    q = FS.quarantine_csv(spark, f"{tmp_dir}/in", "id long, text string, n int", f"{tmp_dir}/out", required=["id", "text"])
    assert sorted(map(tuple, q.rows.collect())) == [(1, 'a\n"b"', 5), (7, "g, h", None)]
    rejects = {(r.reason, (r[FS.RECORD] or "").strip()) for r in q.rejects.collect()}
    assert rejects == {("damaged", "2,c,five"), ("damaged", "3,d"), ("damaged", "4,e,6,7"), ("missing id", ""),
                       ("missing text", ""), ("damaged", "x,NA,1")}
    assert q.counts == {"read": 8, "kept": 2, "rejected": 6, "damaged": 4, "missing id": 1, "missing text": 1}
    assert q.rows.columns == ["id", "text", "n"] and q.rejects.columns == ["id", "text", "n", FS.RECORD, "reason"]
    # the strict scan still fails on the same files, and both on a column that is not there
    with pytest.raises(Exception):
        FS.read_csv(spark, f"{tmp_dir}/in", "id long, text string, n int").collect()
    for f in (lambda: FS.read_csv(spark, f"{tmp_dir}/in", "z int", ["z"]),
              lambda: FS.quarantine_csv(spark, f"{tmp_dir}/in", "z int", f"{tmp_dir}/o2", ["z"])):
        with pytest.raises(ColumnContractError):
            f()
    with pytest.raises(ValueError, match="reserved"):
        FS.quarantine_csv(spark, f"{tmp_dir}/in", "id long, reason string", f"{tmp_dir}/o3")


def test_quarantine_of_clean_and_empty_files(spark, tmp_dir):
    df = spark.range(50).select("id", F.concat(F.lit("t "), "id").alias("text"))
    FS.write_csv(df, f"{tmp_dir}/a")
    q = FS.quarantine_csv(spark, f"{tmp_dir}/a", "id long, text string", f"{tmp_dir}/b", ["id"])
    assert sorted(q.rows.collect()) == sorted(df.collect()) and q.rejects.count() == 0 and q.counts["kept"] == 50
    with open(f"{tmp_dir}/e.csv", "w") as f:
        f.write("id,text\n")
    q = FS.quarantine_csv(spark, f"{tmp_dir}/e.csv", "id long, text string", f"{tmp_dir}/c", ["id"])
    assert q.rows.count() == 0 and q.counts == {"read": 0, "kept": 0, "rejected": 0, "damaged": 0, "missing id": 0}


# ---- reports over streams ------------------------------------------------------------------

SCORED = "row_id long, ts timestamp, dataset string, gold string, pred_label string, pred_confidence double"


def test_streamed_report_equals_the_batch_report(spark, tmp_dir):
    """Files arrive out of order and some twice; a row later than the watermark counts nowhere."""
    rng = random.Random(5)
    rows = [(i, f"2024-01-{1 + i // 100:02d} 00:{i % 60:02d}:00", rng.choice("ab"), rng.choice("xy"), rng.choice("xyz"), rng.random())
            for i in range(900)]
    df = spark.createDataFrame(rows, SCORED.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).cache()
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"

    def go(part):
        part.coalesce(1).write.mode("append").parquet(src)
        q = R.report_stream(spark, src, SCORED, out, ck, lateness="4 days")
        assert q.awaitTermination(180) and q.exception() is None
        return sorted(tuple(r)[:4] + (round(r.confidence, 9),)
                      for r in spark.read.parquet(f"{out}/report").drop("epoch").collect())

    def want(part):
        return sorted(tuple(r)[:4] + (round(r.confidence, 9),) for r in R.label_report(part).collect())

    assert go(df.where("row_id < 300")) == want(df.where("row_id < 300"))
    assert go(df.where("row_id between 200 and 499")) == want(df.where("row_id < 500"))        # a part comes again
    late = df.where("row_id between 600 and 899")
    assert go(late) == want(df.where("row_id < 500 or row_id >= 600"))
    assert go(df.where("row_id between 550 and 599")) == want(df.where("row_id < 500 or row_id >= 550"))  # late, but in time
    stale = df.where("row_id = 0").withColumn("row_id", F.lit(5000).cast("long"))
    assert go(stale) == want(df.where("row_id < 500 or row_id >= 550"))                        # too late
    report = spark.read.parquet(f"{out}/report").drop("epoch")
    shares = R.distribution(report).collect()
    assert all(abs(sum(r.p for r in shares if r.dataset == d) - 1) < 1e-9 for d in "ab")


def test_stream_state_holds_no_rows_but_keys_and_groups(spark, tmp_dir):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("dataset"),
                                 F.lit("x").alias("gold"), F.lit("x").alias("pred_label"), F.lit(0.5).alias("pred_confidence"))
    df.write.parquet(f"{tmp_dir}/in")
    q = R.report_stream(spark, f"{tmp_dir}/in", SCORED, f"{tmp_dir}/out", f"{tmp_dir}/ck")
    q.awaitTermination(120)
    states = [s.numRowsTotal for p in q.recentProgress[:1] for s in p.stateOperators]
    groups, keys = sorted(states)
    assert groups == 1 and 190 <= keys <= 200  # the oldest keys may already have left
