"""A merge in pieces against the merge of the same files in one task."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from burin.functions import documents, pdf
from burin.operators import pdf_files, ranges
from burin.sources import packages
from burin.sources.artifacts import read_files

SCHEMA = "target string, ord long, bytes binary"


def made(i: int) -> bytearray:
    return bytearray(documents.txt_to_pdf("\n".join(f"archivo {i} línea {j}" for j in range(30 * (i % 5) + 1))))


def whole(rows) -> dict:
    out: dict = {}
    for r in sorted((r for r in rows if r["bytes"] is not None), key=lambda r: r["at"]):
        assert r["at"] == len(out.setdefault(r["target"], b""))  # pieces neither overlap nor leave a gap
        out[r["target"]] += bytes(r["bytes"])
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(5)
    rows = [("hot", 100 - i, made(i)) for i in range(90)] + [("b", i, made(i)) for i in range(3)] + [(None, 7, made(4)), ("one", None, made(2)), ("one", 1, made(3))]
    rows += [("same", 1, made(1))] * 2 + [("bad", 1, made(0)), ("bad", 3, bytearray(b"x")), ("bad", 2, bytearray(b"y")), ("none", 1, None), ("empty", 1, bytearray())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most, node", [(20, 8), (1 << 20, 1024)])
def test_pieces_are_the_merged_file(spark, files, monkeypatch, most, node):
    monkeypatch.setattr(pdf_files, "NODE", node)
    rows = pdf_files.merge(spark.createDataFrame(files, SCHEMA), "target", "ord", most=most).collect()
    got = whole(rows)
    assert set(got) == {"hot", "b", None, "one", "same"}
    for target, data in got.items():
        own = [bytes(b) for t, o, b in sorted((f for f in files if f[0] == target), key=lambda f: -1 if f[1] is None else f[1])]
        one = pdf.merged(own)
        assert pdf.to_text(data) == pdf.to_text(one) and pdf.page_count(data) == pdf.page_count(one)
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
        size = int(re.match(rb"xref\n0 (\d+)\n", data[start:])[1])
        entries = re.findall(rb"(\d{10}) (\d{5}) [nf] \n", data[start:])
        assert len(entries) == size == len(re.findall(rb"\d+ 0 obj\n", data)) + 1
        for number, (at, _) in enumerate(entries[1:], 1):
            assert data[int(at) :].startswith(b"%d 0 obj\n" % number)
    assert sum(len(re.findall(rb"/Parent 2 0 R", got[t])) for t in ("hot",)) == -(-90 // node)
    wrong = {r["target"]: r["error"] for r in rows if r["error"]}
    assert set(wrong) == {"bad", "none", "empty"} and wrong["bad"].startswith("Archivo 2: ") and wrong["none"] == wrong["empty"] == "Archivo 1: Se necesita un archivo"
    assert all(r["at"] is None and r["bytes"] is None for r in rows if r["error"])


def test_no_files_and_too_long_files(spark, files, monkeypatch):
    assert pdf_files.merge(spark.createDataFrame([], SCHEMA), "target", "ord").collect() == []
    monkeypatch.setattr(pdf_files, "LAST_PLACE", 20_000)
    rows = pdf_files.merge(spark.createDataFrame([f for f in files if f[0] in ("hot", "b")], SCHEMA), "target", "ord").collect()
    assert set(whole(rows)) == {"b"} and [tuple(r) for r in rows if r["error"]] == [("hot", None, None, "El archivo resultante es demasiado grande")]


def test_pieces_are_saved_as_files(spark, files, tmp_path):
    rows = pdf_files.merge(spark.createDataFrame(files, SCHEMA), "target", "ord").where("target IN ('hot', 'b', 'same')")
    named = rows.withColumn("name", F.concat("target", F.lit(".pdf"))).cache()
    packages.save_pieces(named, str(tmp_path / "out"))
    assert {r["name"]: bytes(r["bytes"]) for r in read_files(spark, str(tmp_path / "out")).collect()} == {f"{t}.pdf": b for t, b in whole(named.collect()).items()}
    with pytest.raises(Exception, match="does not follow"):
        packages.save_pieces(named.where("at = 0 OR at > 2000"), str(tmp_path / "gap"))
    assert not list((tmp_path / "gap").rglob("*.pdf"))


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_sums_before_each_row(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 5, 9])) for i in range(300)]
    got = ranges.sums_before(spark.createDataFrame(rows, "k string, pos int, i int, v int"), "k", "pos", ["v"], ("i",), most).collect()
    place = lambda r: (-1 if r[1] is None else r[1], r[2])
    assert {r["i"]: r["v_before"] for r in got} == {r[2]: sum(o[3] or 0 for o in rows if o[0] == r[0] and place(o) < place(r)) for r in rows}
