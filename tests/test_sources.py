"""Readers of pages and bodies."""

from docrecords.sources import pages as P


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>né</p>".encode())
    (tmp_path / "b.html").write_bytes("<p>né</p>".encode("latin-1"))
    (tmp_path / "empty.html").write_bytes(b"")
    rows = P.read_html_files(spark, f"{tmp_path}/*.html").collect()
    assert {r.url.rsplit("/", 1)[1]: r.html for r in rows} == {"a.html": "<p>né</p>", "b.html": "<p>né</p>"}
    assert len({r.page_id for r in rows}) == 2  # Spark passes over empty files
    again = {r.url: r.page_id for r in P.read_html_files(spark, f"{tmp_path}/*.html").collect()}
    assert again == {r.url: r.page_id for r in rows}
    text = P.read_text_files(spark, f"{tmp_path}/a.html").first()
    assert text.html == "<p>né</p>" and text.url.endswith("a.html")


def test_declared_encodings(spark):
    word = "Вишня"
    rows = [
        (1, word.encode("cp1251"), "windows-1251"),
        (2, "桜".encode("shift_jis"), "Shift_JIS"),
        (3, word.encode(), "no-such-encoding"),
        (4, word.encode(), None),
        (5, "é".encode("latin-1"), None),
        (6, "é".encode("latin-1"), "utf-8"),
        (7, None, "utf-8"),
        (8, b"", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, body binary, encoding string").coalesce(1)
    got = {r.page_id: r.html for r in P.decode_pages(df).collect()}
    assert got == {1: word, 2: "桜", 3: word, 4: word, 5: "é", 6: "é", 7: None, 8: ""}
    assert P.decode_pages(df.limit(0)).columns == ["page_id", "html"]
