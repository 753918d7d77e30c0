"""Chapter tables: what is replaced, what stays, and how many folders there are."""

from __future__ import annotations

from fabula.sources import artifacts


def test_folders_do_not_grow_with_chapters(spark, tmp_path):
    path = tmp_path / "t"
    schema = "book_id string, chapter_number int, text string"
    rows = spark.range(1, 2501).selectExpr("concat('0', id % 2) AS book_id", "cast(id AS int) AS chapter_number", "concat('t', id) AS text")
    artifacts.write_chapter_table(rows, str(path))
    assert len(list(path.glob("*/*"))) == 6 and len(list(path.rglob("*.parquet"))) <= 12
    again = spark.createDataFrame([("01", 7, "new"), ("01", 7, "more"), ("03", 7, "other"), (None, None, "null")], schema)
    for _ in range(2):
        artifacts.write_chapter_table(again, str(path))
    have = sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(path)).select("book_id", "chapter_number", "text").fillna({"book_id": "-", "chapter_number": -1}).collect())
    want = [(f"0{i % 2}", i, f"t{i}") for i in range(1, 2501) if i != 7] + [("01", 7, "new"), ("01", 7, "more"), ("03", 7, "other"), ("-", -1, "null")]
    assert have == sorted(want)


def test_columns_that_new_chapters_lack_stay_in_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.write_chapter_table(spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6)], "book_id int, chapter_number int, text string, n int"), path)
    artifacts.write_chapter_table(spark.createDataFrame([(1, 2, "new")], "book_id int, chapter_number int, text string"), path)
    assert {(r.text, r.n) for r in spark.read.option("mergeSchema", True).parquet(path).collect()} == {("a", 5), ("new", None)}
