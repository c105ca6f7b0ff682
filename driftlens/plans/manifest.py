"""What each stage of a run read, with which parameters, and what it wrote.

A manifest is one row beside the stage's output, removed before the stage starts and
written after everything else, so a stage that was killed has none. ``inputs`` names what
was read: a digest of the names, sizes and times of landed files, or the run ids of
earlier stages. A stage is up to date if it has a manifest with the same inputs and
parameters."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

from ..session import remove_path
from ..sources.files import write_parquet

_ROW = "stage string, run_id string, inputs string, params string, counts map<string,bigint>"


class Manifest(NamedTuple):
    stage: str
    run_id: str
    inputs: str
    params: str
    counts: dict


def _files(spark: SparkSession, path: str):
    """(path, hadoop path, file system) if there is such a path, else None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (p, fs) if fs.exists(p) else None


def digest(spark: SparkSession, *paths: str) -> str:
    """md5 of the files under ``paths``: relative names, sizes and times. Listed on the
    driver, which lists the files of a scan anyway."""
    seen = []
    for path in paths:
        found = _files(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        p, fs = found
        root = str(fs.makeQualified(p).toString())
        each = fs.listFiles(p, True)
        own = []
        while each.hasNext():
            f = each.next()
            own.append((str(f.getPath().toString())[len(root):], f.getLen(), f.getModificationTime()))
        seen.append(sorted(own))
    return hashlib.md5(json.dumps(seen).encode()).hexdigest()


def read(spark: SparkSession, out_dir: str, stage: str) -> Manifest | None:
    path = f"{out_dir}/manifest/{stage}"
    # the marker of a finished write: a manifest cut short does not count
    if _files(spark, f"{path}/_SUCCESS") is None:
        return None
    return Manifest(*spark.read.schema(_ROW).parquet(path).first())


def forget(spark: SparkSession, out_dir: str, stage: str) -> None:
    if _files(spark, f"{out_dir}/manifest/{stage}"):
        remove_path(spark, f"{out_dir}/manifest/{stage}")


def record(spark: SparkSession, out_dir: str, stage: str, inputs: str, params: dict, counts: dict) -> Manifest:
    m = Manifest(stage, uuid.uuid4().hex, inputs, json.dumps(params, sort_keys=True, default=str), counts)
    write_parquet(spark.createDataFrame([m], _ROW).coalesce(1), f"{out_dir}/manifest/{stage}")
    return m
