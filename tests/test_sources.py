"""Packages, result files, CSV by byte ranges, and the intake of new files."""

from __future__ import annotations

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from burin.functions.documents import parse_csv
from burin.sources import packages
from burin.sources.artifacts import read_files, stream_files
from burin.sources.csv_lines import read_rows
from burin.streaming import intake


@pytest.mark.parametrize("split", ["40", "100", "128m"])
def test_rows_of_files_cut_anywhere(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for n in range(12):
        text = "".join(rng.choice(['"', '""', ",", "\n", "a", "bc ", "\r", "é", "\n\n"] + (['"x\ny"'] * 3)) for _ in range(rng.randint(0, 120)))
        text = (text + '"' if text.count('"') % 2 else text).rstrip("\r\n") + "z\n" * (n % 2)
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
        want[f"{n}.csv"] = parse_csv(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_rows(spark, str(tmp_path), "*.csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["row"])):
        got.setdefault(os.path.basename(r["path"]), []).append(r["cells"])
        assert r["row"] == len(got[os.path.basename(r["path"])]) - 1
    assert got == {k: v for k, v in want.items() if v}


def package(names):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n), (n * 50).encode(), zipfile.ZIP_STORED if n == "mimetype" else zipfile.ZIP_DEFLATED)
    return held.getvalue()


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.zip").write_bytes(package(["mimetype", "d/x.xml", "y.txt", "e/"]))
    (source / "b.zip").write_bytes(package([f"n{i}.txt" for i in range(40)]))
    (source / "broken.zip").write_bytes(b"PK\x03\x04 no package")
    (source / "none.txt").write_bytes(b"")
    return source


def test_members_by_ranges_and_pushed_filters(spark, folder):
    rows = packages.read_packages(spark, str(folder), split_bytes=300)
    assert rows.rdd.getNumPartitions() > 4
    got = {(os.path.basename(r["package"]), r["member"]): bytes(r["bytes"]) for r in rows.collect()}
    assert got == {("a.zip", n): (n * 50).encode() for n in ("mimetype", "d/x.xml", "y.txt")} | {("b.zip", f"n{i}.txt"): (f"n{i}.txt" * 50).encode() for i in range(40)}
    some = rows.where(F.col("member").endswith(".xml") & F.col("package").contains("a.zip"))
    assert [(r["member"], r["ord"]) for r in some.collect()] == [("d/x.xml", 1)]
    assert packages.read_packages(spark, str(folder), content=False).where("member = 'y.txt'").select("size", "bytes").collect() == [(250, None)]
    reader = packages.ZipReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("member",), "y.txt"), GreaterThan(("size",), 3)]))
    assert len(left) == 1 and reader.passes("member", "y.txt") and not reader.passes("member", "z")


def test_members_of_artifacts_in_batch_and_stream(spark, folder, tmp_path):
    want = {("a.zip", n) for n in ("mimetype", "d/x.xml", "y.txt")} | {("b.zip", f"n{i}.txt") for i in range(40)}
    named = lambda df: {(os.path.basename(r["package"]), r["member"]) for r in df.select("package", "member").collect()}
    assert named(packages.members(read_files(spark, str(folder)))) == want
    query = packages.members(stream_files(spark, str(folder), "*.zip")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert named(spark.read.parquet(str(tmp_path / "out"))) == want
    first = read_files(spark, str(folder)).select("name", packages.first_entry(F.col("bytes")).alias("f")).collect()
    assert {r["name"]: r["f"] and tuple(r["f"]) for r in first} == {"a.zip": ("mimetype", True), "b.zip": ("n0.txt", False), "broken.zip": None}  # Spark does not list empty files


def test_files_are_written_and_read_again(spark, tmp_path):
    target = tmp_path / "results"
    rows = [(f"f{i}.txt", bytearray(b"%d" % i), "extra") for i in range(30)] + [("../up/f1.txt", bytearray(b"up"), "x"), ("", bytearray(b"e"), "x"), (None, bytearray(b"n"), "x"), ("gone", None, "x")]
    packages.save_files(spark.createDataFrame(rows, "name string, bytes binary, other string").coalesce(1), str(target))
    got = {r["name"]: bytes(r["bytes"]) for r in read_files(spark, str(target)).collect()}
    assert got == {f"f{i}.txt": b"%d" % i for i in range(30)} | {"f1 (2).txt": b"up", "documento": b"e", "documento (2)": b"n"}
    packages.save_files(spark.createDataFrame([("new.txt", bytearray(b"1"))], "name string, bytes binary"), str(target), "overwrite")
    assert [r["name"] for r in read_files(spark, str(target)).collect()] == ["new.txt"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    target = tmp_path / "results"
    bad = spark.range(0, 40, numPartitions=4).select(F.format_string("f%d", "id").alias("name"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").cast("binary").alias("bytes"))
    with pytest.raises(Exception, match="broken"):
        packages.save_files(bad, str(target))
    assert not [f for _, _, files in os.walk(target) for f in files]


def test_each_new_file_is_taken_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    run = lambda: intake.start(spark, str(source), f"{out}/yes", f"{out}/no", f"{out}/ck").awaitTermination(180)
    seen = lambda kind, *names: sorted(tuple(r) for r in spark.read.parquet(f"{out}/{kind}").select(*names).collect())
    (source / "a.html").write_bytes(b"<p>")
    (source / "b.html").write_bytes(b"<p>")
    (source / "c.what").write_bytes(b"\x00\x01")
    run()
    assert seen("yes", "name") == [("a.html",)]
    assert seen("no", "name", "reason") == [("b.html", intake.REPEATED), ("c.what", intake.UNKNOWN)]
    run()
    (source / "e.html").write_bytes(b"<p>")
    (source / "f.html").write_bytes(b"<b>")
    run()
    run()
    assert seen("yes", "name") == [("a.html",), ("f.html",)]
    assert [r for r in seen("no", "name", "reason") if r[0] == "e.html"] == [("e.html", intake.REPEATED)] and len(seen("no", "name")) == 3
    # A batch that is repeated after a failure replaces what it wrote.
    again = read_files(spark, str(source), "[ef].html")
    last = max(r[0] for r in seen("yes", "batch"))
    intake.take_batch(again, last, f"{out}/yes", f"{out}/no")
    assert seen("yes", "name") == [("a.html",), ("f.html",)] and len(seen("no", "name")) == 3
