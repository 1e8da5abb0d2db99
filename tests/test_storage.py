import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from storyloom import schemas
from storyloom.sources import files
from storyloom.sources.snapshot import Conflict, Snapshot
from storyloom.streaming import pipelines


def test_schemas(spark):
    assert len(schemas.TABLES) == 20
    assert all(set(d) <= set(schemas.schema(t).fieldNames()) for t, d in schemas.DEFAULTS.items())


def test_snapshot(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/kb")
    assert s.version == 0 and s.table("rules").count() == 0
    rules = spark.createDataFrame([("r1", "b1", "x"), ("r2", None, "y")], "id string, book_id string, name string")
    assert s.commit({"rules": rules}) == 1
    with pytest.raises(RuntimeError):
        s.commit({"rules": rules}, expected=0)
    with pytest.raises(ValueError):
        s.commit({"nothing": rules})
    s.commit({"rules": s.table("rules").where("id = 'r1'").union(s.table("rules").where("id = 'r2'"))})
    assert s.compact() == 2 and s.table("rules").count() == 2  # the two buckets of the first version
    s.reset_book("b1")
    assert [r.id for r in s.table("rules").collect()] == ["r2"]


def test_two_writers(spark, tmp_path):
    """Of two commits of one version the second fails, whatever it expected, and the first stays whole."""
    a, b = (Snapshot(spark, f"file://{tmp_path}/kb") for _ in "ab")
    row = lambda i: spark.createDataFrame([(i, "b1", "x")], "id string, book_id string, name string")
    seen = b._read()
    a.commit({"rules": row("r1")})
    with pytest.raises(Conflict):
        b._publish(seen, {"rules": b._write("rules", row("r2"))})
    assert a.version == 1 and [r.id for r in b.table("rules").collect()] == ["r1"]
    assert b.commit({"rules": row("r2")}) == 2


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/kb")
    s.commit({"rules": spark.range(200).selectExpr("concat('r', id) AS id", "'b' AS book_id", "'old' AS name")})
    before = s._read()["tables"]["rules"]
    new = spark.createDataFrame([("r7", "b", "new"), ("fresh", "b", "new")], "id string, book_id string, name string")
    put = lambda name, old, rows: old.join(rows.select("id"), "id", "left_anti").select("id", "book_id", "name").unionByName(rows)
    assert s.merge({"rules": new}, put, 1) == 2
    after = s._read()["tables"]["rules"]
    assert 1 <= sum(before[k] != v for k, v in after.items() if k in before) <= 2
    rows = {r.id: r.name for r in s.table("rules").collect()}
    assert len(rows) == 201 and rows["r7"] == rows["fresh"] == "new" and rows["r8"] == "old"
    with pytest.raises(Conflict):
        s.merge({"rules": new}, put, 1)


def test_lore_and_pdf_and_epub(spark, tmp_path):
    (tmp_path / "lore").mkdir()
    (tmp_path / "lore" / "a.json").write_text(json.dumps({"title": "A", "kind": "place", "content": "x"}))
    (tmp_path / "lore" / "b.md").write_text("# Bee\ntext")
    (tmp_path / "lore" / "c.json").write_text("{}")
    (tmp_path / "lore" / "d.json").write_text("broken")
    assert {(r.ref, r.title, r.kind) for r in files.lore(spark, f"file://{tmp_path}/lore").collect()} == {("a", "A", "place"), ("b", "Bee", "")}
    stream = zlib.compress("BT (Chapter 1) Tj T* (It \\(was\\) so) Tj ET BT <FEFF4F60597D> Tj ET".encode("latin-1"))
    pdf = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream endobj\n%%EOF"
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.pdf").write_bytes(pdf)
    (tmp_path / "books" / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "books" / "c.epub").write_bytes(files.epub("W", [("One & two", "a < b\n\nc"), ("", "z")]))
    rows = {(r.path.rsplit("/", 1)[1], r.title, r.content, r.error is None) for r in files.books(spark, f"file://{tmp_path}/books").collect()}
    assert rows == {("a.pdf", "Chapter 1", "It (was) so\n你好", True), ("b.pdf", None, None, False), ("c.epub", "One & two", "One & two\na < b\nc", True), ("c.epub", "", "z", True)}


def test_long_members_come_in_parts(spark, tmp_path):
    (tmp_path / "w.zip").write_bytes(files.write_container({"long.txt": b"0123456789", "none.txt": b""}, []))
    rows = files.container_members(spark, f"file://{tmp_path}", 4).where("path <> 'history.jsonl'").orderBy("path", "part").collect()
    assert [(r.path, r.part, bytes(r.content)) for r in rows] == [("long.txt", 0, b"0123"), ("long.txt", 1, b"4567"), ("long.txt", 2, b"89"), ("none.txt", 0, b"")]


def test_text_books(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\nfirst\n\n第二章 雪\n second\nChapter 3\n")
    rows = [(r.idx, r.title, r.content.strip()) for r in files.text_books(spark, f"file://{tmp_path}").orderBy("idx").collect()]
    assert rows == [(0, "", "intro"), (1, "One", "first"), (2, "第二章 雪", "second"), (3, "Chapter 3", "")]


def test_containers(spark, tmp_path):
    data = files.write_container({"b.json": b"{}", "../evil": b"x", "a.txt": b"hi"}, [{"b": 1, "a": 2}])
    (tmp_path / "w.zip").write_bytes(data)
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    got = {(r.path, bytes(r.content) if r.content is not None else None, r.skipped) for r in files.container_members(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.txt", b"hi", None), ("b.json", b"{}", None), ("history.jsonl", b'{"a":2,"b":1}\n', None), (None, None, "not a container")}


def test_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>')
        z.writestr("O/c.xhtml", "<html><head><title>t</title></head><body><h1>One</h1><p>a &lt; b</p></body></html>")
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: (r.title, r.content, r.error is None) for r in files.books(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.epub": ("One", "One\na < b", True), "b.docx": (None, None, False)}


def test_stream_ingests_once(spark, tmp_path):
    folder = tmp_path / "in" / "book_id=b1"
    folder.mkdir(parents=True)
    snapshot = Snapshot(spark, f"file://{tmp_path}/kb")

    def run():
        stream = pipelines.chapter_stream(spark, f"file://{tmp_path}/in")
        pipelines.ingest(stream, snapshot, f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    put = lambda name, content, t: (folder / name).write_text(json.dumps({"id": "c1", "title": "T", "content": content, "updated": t}))
    put("1.json", "one", 1.0)
    run()
    assert snapshot.version == 1
    put("2.json", "one", 2.0)
    run()
    assert snapshot.version == 1  # the same content
    put("3.json", "two", 3.0)
    run()
    assert snapshot.version == 2 and snapshot.table("chapters").count() == 1
    assert [(r.chapter_id, r.status) for r in snapshot.table("kb_dirty_queue").collect()] == [("c1", "pending")]


def test_windows_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "a", 4.0)], "ts string, event_type string, value double")
    rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = pipelines.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.total) for r in spark.table("wins").collect()] == [(2, 3.0)]
