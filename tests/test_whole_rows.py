"""Rows that the SQL of a query leaves out."""

from storyloom.plans import records, storage


def test_markup_headings_and_the_word_sought(spark, tmp_path):
    rows = [("b", "c1", "The long page of a<b", "x < y &amp; z", 1), ("b", "c2", "Plain", "one\n# Two\nthree", 2)]
    spark.createDataFrame(rows, "book_id string, chapter_id string, title string, content string, idx int").write.parquet(f"{tmp_path}/chapter_list.parquet")
    texts = {r.page_id: r.text for r in records.page_texts(spark, str(tmp_path)).collect()}
    assert texts["c1"] == "The long page of a<b The long page of a<b none Next page x < y &amp; z"
    assert {r.chapter_id: r.parts for r in storage.text_split_at_headings(spark, str(tmp_path)).collect()} == {"c1": 2, "c2": 4}
