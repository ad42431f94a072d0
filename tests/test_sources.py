import pytest
from pyspark.sql import functions as F

from bidloom.__main__ import main
from bidloom.functions import text
from bidloom.session import materialise, remove_tables, shared_folder
from bidloom.sources import parsers, store


class Fails:
    def pages(self, content):
        raise ValueError("no file")


class Reader:
    def __init__(self, there):
        self.there = there

    def available(self):
        return self.there

    def read(self, pixels, w, h):
        if w == 0:
            raise ValueError
        return f"{len(pixels)} of {w * h}", 0.5


def test_pages_and_errors_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\ftwo\fthree")), ("b", bytearray(b""))], "path string, content binary")
    got = {(r["path"], r["chunk"], r["page"]): r["text"] for r in parsers.pages(files, parsers.PlainPages(), 2).collect()}
    assert got == {("a", 0, 1): "one", ("a", 0, 2): "two", ("a", 1, 3): "three", ("b", 0, 1): ""}
    bad = parsers.pages(files, Fails()).collect()
    assert {(r["path"], r["page"], r["error"]) for r in bad} == {("a", None, "ValueError: no file"), ("b", None, "ValueError: no file")}
    assert isinstance(parsers.PlainPages(), parsers.PageParser)


def test_readers_are_chosen_by_name_and_availability(spark):
    known = parsers.Readers()
    assert known.choose() is None
    known.register("off", Reader(False))
    known.register("on", Reader(True))
    assert known.choose() is known.known["on"] and known.choose("off") is None
    with pytest.raises(ValueError):
        known.choose("none")
    rows = spark.createDataFrame([(1, bytearray(b"xy"), 2, 3), (2, None, 1, 1), (3, bytearray(b"z"), 0, 0)], "picture_id long, pixels binary, w int, h int")
    assert {r["picture_id"]: r["text"] for r in parsers.picture_texts(rows, known.choose()).collect()} == {1: "2 of 6", 2: None, 3: None}
    assert {r["text"] for r in parsers.picture_texts(rows, None).collect()} == {None}


class Lengths:
    def vectors(self, texts):
        return [[float(len(t))] for t in texts]


def test_each_text_is_encoded_once(spark):
    rows = spark.createDataFrame([("ab",), ("ab",), (None,), ("abc",)], "text string")
    assert sorted(r["embedding"][0] for r in parsers.embedded(rows, Lengths(), 1).collect()) == [2.0, 3.0]


def test_metadata_in_the_open(spark):
    pdf = rb"%PDF-1.4 1 0 obj <</Type /Page>> <</Type /Pages>> <</Type/Page >> /Author (A \(B\) C) /Producer(Press 3.1) /CreationDate (D:20240131235959) /ID [ <00FFaa> <00> ]"
    r = parsers.pdf_metadata(spark.createDataFrame([("a", bytearray(pdf)), ("b", bytearray(b""))], "path string, content binary")).orderBy("path").collect()
    assert r[0]["author"] == r"A \(B\) C" and r[0]["creator"] is None and r[0]["producer"] == "Press 3.1" and r[0]["file_id"] == "00ffaa" and r[0]["pages"] == 2
    assert r[1]["author"] is None and r[1]["pages"] == 0


def test_tables_are_written_over_by_partition_and_removed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")
    store.write_table(df, str(tmp_path / "t"), "p")
    store.write_table(spark.createDataFrame([(3, "b")], "id long, p string"), str(tmp_path / "t"), "p")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (3, "b")}
    kept = materialise(df)
    assert kept.count() == 2 and shared_folder(spark)
    remove_tables(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        materialise_again = spark.read.parquet(kept.inputFiles()[0])
        materialise_again.count()
    assert materialise(df).count() == 2


def test_errors_are_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id long, t string")
    got = {(r["key"], r["message"]) for r in store.errors(df, "t", "id", "load", {"null": F.col("t").isNull(), "empty": F.col("t") == ""}).collect()}
    assert got == {("1", "null"), ("2", "empty")}


def test_file_names_and_data_uris(spark):
    df = spark.createDataFrame([("a/b: c*d.pdf", bytearray(b"x")), ("n" * 100, None)], "n string, b binary")
    got = [tuple(r) for r in df.select(text.file_name(F.col("n")), text.data_uri(F.col("b"))).collect()]
    assert got == [("a_b_c_d.pdf", "data:image/jpeg;base64,eA=="), ("n" * 80, None)]


def test_command_line(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "report_counters" in capsys.readouterr().out
    assert main(["run", data, str(tmp_path), "no_such"], spark) == 2
    assert main(["run", data, str(tmp_path), "report_counters"], spark) == 0 and spark.read.parquet(f"{tmp_path}/report_counters").count() == 1
    assert main(["item", data, str(tmp_path), "DOC_AUTHOR_SIMILAR"], spark) == 0 and spark.read.text(f"{tmp_path}/DOC_AUTHOR_SIMILAR").count() > 0
