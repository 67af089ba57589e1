"""File sources, assets, sinks, and a directory from end to end."""

import hashlib
import io
import json
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from configsieve.functions.docx import docx_media, docx_text
from configsieve.functions.pictures import picture_header, shows_something
from configsieve.operators import assets, summary
from configsieve.plans.extract import process_directory
from configsieve.sinks import results
from configsieve.sources import control, files
from configsieve.operators.history import HISTORY_SCHEMA

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SCHEMA = {"type": "object", "required": ["host"], "properties": {"host": {"type": "string"}}}


def paragraph(*runs):
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


def text(value):
    return f'<w:t xml:space="preserve">{value}</w:t>'


def cell(value, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{paragraph(text(value))}</w:tc>"


def docx(body, media=()):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{NAMESPACE}"><w:body>{body}</w:body></w:document>')
        for name, content in media:
            archive.writestr(f"word/media/{name}", content)
    return packed.getvalue()


def png(width, height, value=255):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = (b"\x00" + bytes([value]) * width) * height
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_docx_text():
    body = (
        paragraph(text("First"), "<w:tab/>", text("line"), "<w:br/>", text("next"), '<w:br w:type="page"/>')
        + paragraph(text("   "))
        + f'<w:p><w:hyperlink><w:r>{text("link")}</w:r></w:hyperlink><w:r>{text(" end")}</w:r></w:p>'
        + "<w:tbl><w:tr>" + cell(" wide ", '<w:gridSpan w:val="2"/>') + cell("tall", '<w:vMerge w:val="restart"/>') + "</w:tr>"
        + "<w:tr>" + cell("a") + cell("  ") + cell("", "<w:vMerge/>") + "</w:tr><w:tr>" + cell("") + "</w:tr></w:tbl>"
        + paragraph(text("Last"))
    )
    assert docx_text(docx(body)) == "First\tline\nnext\nlink end\nLast\nwide | wide | tall\na | tall"


def jpeg(width, height):
    app = b"\xff\xe0" + struct.pack(">H", 300) + b"\x00" * 298
    frame = b"\xff\xc2" + struct.pack(">HBHH", 17, 8, height, width) + b"\x00" * 10
    return b"\xff\xd8" + app + frame


def test_picture_headers():
    assert picture_header(png(60, 70)) == ("png", 60, 70)
    assert picture_header(jpeg(640, 480)) == ("jpeg", 640, 480)
    assert picture_header(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert picture_header(b"BM" + b"\x00" * 16 + struct.pack("<ii", 7, -8)) == ("bmp", 7, 8)
    huge = b"\x89PNG\r\n\x1a\n" + b"\xff" * 20
    assert picture_header(huge) == ("png", None, None)
    assert picture_header(b"\x89PNG\r\n\x1a\n") == picture_header(b"") == picture_header(b"text") == (None, None, None)


@pytest.fixture(scope="module")
def directory(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "sub").mkdir()
    (root / "a.txt").write_text('Settings:\nhost = "db1.example.org"\n', encoding="utf-8")
    (root / "sub" / "B.YML").write_text("server:\n  ip: 10.0.0.1\n", encoding="utf-8")
    (root / "c.docx").write_bytes(docx(paragraph(text("host = héllo")), [
        ("image1.png", png(60, 60)), ("image2.png", png(10, 90)), ("image3.jpg", jpeg(64, 64))]))
    (root / "d.docx").write_bytes(docx(paragraph(text("no settings")), [("image9.png", png(60, 60))]))
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "e.pdf").write_bytes(b"%PDF")
    (root / "skip.exe").write_bytes(b"MZ")
    return str(root)


def name(path):
    return path.rpartition("/")[2]


def test_discover(spark, directory):
    found = {name(r["path"]): r["doc_type"] for r in files.discover(spark, directory).select("path", "doc_type").collect()}
    assert found == {"a.txt": "text", "B.YML": "yaml", "c.docx": "docx", "d.docx": "docx", "bad.docx": "docx", "e.pdf": "pdf"}


def test_discover_missing_directory(spark):
    with pytest.raises(FileNotFoundError):
        files.discover(spark, "/tmp/no-such-directory-here")


def test_listing_does_not_read_contents(spark, directory):
    plan = files.discover(spark, directory).select("path", "doc_type")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_other_files_are_not_even_listed(spark, directory):
    assert {name(p) for p in files.discover(spark, directory, only=["yaml", "pdf"]).inputFiles()} == {"B.YML", "e.pdf"}


def test_texts_and_answers_are_settled(spark, processed):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert any("/answers-" in f and folder in f for f in processed.inputFiles())


def test_read_documents(spark, directory):
    found = {name(r["path"]): r for r in files.read_documents(spark, directory).collect()}
    assert found["a.txt"]["text"] == 'Settings:\nhost = "db1.example.org"\n'
    assert found["c.docx"]["text"] == "host = héllo"
    assert {n for n, r in found.items() if r["status"] == "failed"} == {"bad.docx", "e.pdf"}
    assert found["bad.docx"]["error"].startswith("BadZipFile") and found["bad.docx"]["text"] is None


def test_hidden_names_are_read(spark, tmp_path):
    for path in ("a.txt", "_notes.txt", ".env.json", "_drafts/b.txt", ".conf/c.yaml", ".conf/deep/_more/d.txt", "_drafts/_e.txt", ".skip.exe"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path, encoding="utf-8")
    for directory in (str(tmp_path), f"file://{tmp_path}"):
        found = {r["path"].partition(f"{tmp_path}/")[2]: r for r in files.read_documents(spark, directory).collect()}
        assert set(found) == {"a.txt", "_notes.txt", ".env.json", "_drafts/b.txt", ".conf/c.yaml", ".conf/deep/_more/d.txt", "_drafts/_e.txt"}
        assert all(r["text"] == p and r["path"].startswith("file:/") for p, r in found.items())


def test_large_files_and_old_documents_fail_alone(spark, tmp_path):
    (tmp_path / "small.txt").write_text("small")
    (tmp_path / "large.txt").write_text("x" * 500)
    (tmp_path / "large.docx").write_bytes(docx(paragraph(text("y" * 900))))
    (tmp_path / "old.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"Word.Document.8")
    spark.conf.set(files.LENGTH_LIMIT, "100")
    try:
        found = {name(r["path"]): (r["status"], r["text"], r["error"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(files.LENGTH_LIMIT)
    size = (tmp_path / "large.docx").stat().st_size
    assert found == {
        "small.txt": ("read", "small", None), "large.txt": ("failed", None, "too large to read: 500 bytes"),
        "large.docx": ("failed", None, f"too large to read: {size} bytes"), "old.doc": ("failed", None, "no decoder for doc")}


def test_media_dedupe_and_filter(spark, directory):
    media = files.explode_docx_media(files.discover(spark, directory, only=["docx"]))
    assert media.count() == 4
    digest = hashlib.md5(png(60, 60)).hexdigest()[:8]
    unique = assets.dedupe_assets(media).where(assets.is_valid_asset(F.col("width"), F.col("height")))
    found = sorted((name(r["path"]), r["name"], r["format"]) for r in unique.collect())
    jpg = hashlib.md5(jpeg(64, 64)).hexdigest()[:8]
    assert found == sorted([("c.docx", f"docx_img_{digest}.png", "png"), ("c.docx", f"docx_img_{jpg}.jpeg", "jpeg")])


def test_images(spark, tmp_path):
    for n, content in (("ok", png(60, 60)), ("blank", png(60, 60, 0)), ("small", png(60, 20)), ("broken", b"\x89PNG")):
        (tmp_path / f"{n}.png").write_bytes(content)
    kept = assets.valid_images(files.read_images(spark, str(tmp_path))).select("image.origin").collect()
    assert [name(r["origin"]) for r in kept] == ["ok.png"]


def test_sniff_without_content(spark):
    df = spark.createDataFrame([("x.DOC", None), ("x.txt", None)], "path string, content binary")
    assert {r["path"]: r["format"] for r in assets.sniff_format(df).collect()} == {"x.DOC": "doc", "x.txt": "other"}


def test_load_schema(tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps({"configSchema": SCHEMA}))
    assert control.load_schema(str(path)) == {"configSchema": SCHEMA}
    assert control.load_schema(str(path), "configSchema") == SCHEMA
    path.write_text("{")
    for bad in (path, tmp_path / "absent.json"):
        with pytest.raises(ValueError, match="Invalid schema file"):
            control.load_schema(str(bad))


def test_load_schema_through_spark(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps({"configSchema": SCHEMA}, indent=2))
    assert control.load_schema(f"file://{path}", "configSchema", spark) == SCHEMA
    path.write_text("{")
    for bad in (f"file://{path}", f"file://{tmp_path}/absent.json"):
        with pytest.raises(ValueError, match="Invalid schema file"):
            control.load_schema(bad, None, spark)


def answer(requests):
    """Stands in for the answering service: the host named in the chunk."""
    host = F.regexp_extract("text", r'host = "?([^"\s]+)', 1)
    said = F.when(host != "", F.to_json(F.struct(host.alias("host")))).otherwise("I found nothing")
    return requests.select("doc_id", "chunk_id", said.alias("response"))


@pytest.fixture(scope="module")
def processed(spark, directory):
    return process_directory(spark, directory, answer, spark.createDataFrame([], HISTORY_SCHEMA), SCHEMA)


def test_directory_end_to_end(processed):
    found = {name(r["path"]): (r["c"], r["errors"]) for r in processed.select("path", F.to_json("config").alias("c"), "errors").collect()}
    assert found["a.txt"] == ('{"host":"db1.example.org"}', [])
    assert found["c.docx"] == ('{"host":"héllo"}', [])
    assert found["d.docx"] == found["B.YML"] == ('{"host":""}', [])
    assert found["e.pdf"] == (None, ["no decoder for pdf"]) and found["bad.docx"][0] is None
    assert summary.processing_summary(processed).collect()[0].asDict() == {
        "total_files": 6, "successful_files": 4, "failed_files": 2, "unusable_answers": 2, "missing_answers": 0}


def test_untyped_schema_gives_null(spark, directory):
    nothing = lambda r: r.select("doc_id", "chunk_id", F.lit("x").alias("response"))
    done = process_directory(spark, directory, nothing, spark.createDataFrame([], HISTORY_SCHEMA), {"configSchema": SCHEMA})
    assert summary.processing_summary(done).collect()[0]["successful_files"] == 0


def test_write_results(spark, processed, tmp_path):
    path = str(tmp_path / "rows")
    results.write_results(processed, path)
    rows = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert {name(r["path"]): r["config"] for r in rows}["a.txt"] == {"host": "db1.example.org"}
    assert all(set(r) == {"path", "config"} for r in rows) and sum(r["config"] is None for r in rows) == 2


def test_write_result_map(processed, tmp_path):
    results.write_result_map(processed, str(tmp_path / "map"))
    joined = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "map").glob("part-*")))
    whole = json.loads(joined)
    assert len(whole) == 6 and {name(p): c for p, c in whole.items()}["e.pdf"] is None


def test_empty_directory(spark, tmp_path):
    done = process_directory(spark, str(tmp_path), answer, spark.createDataFrame([], HISTORY_SCHEMA), SCHEMA)
    assert done.count() == 0
    results.write_result_map(done, str(tmp_path / "map"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "map").glob("part-*")))) == {}


def test_mask(spark):
    df = spark.createDataFrame([("credentials", "s3cret"), ("host", "db")], "type string, value string")
    assert [r[0] for r in df.select(results.mask(F.col("value"), F.col("type"))).collect()] == ["***", "db"]


def test_paths_of_all_kinds(spark, tmp_path):
    """Relative paths, `file:` with and without slashes, and a store that only Spark's file systems know."""
    for folder in ("a", "a/_b", "a/_b/.c", "with blank"):
        (tmp_path / folder).mkdir()
    for n, place in enumerate((".", "a", "a/_b", "a/_b/.c", "with blank")):
        (tmp_path / place / f"n{n}.txt").write_text(f"text {n}")
        (tmp_path / place / f"_n{n}.txt").write_text(f"hidden {n}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./at", f"file://{tmp_path}")
    there = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    everything = {f"{kind} {n}" for kind in ("text", "hidden") for n in range(5)}
    for directory in (str(tmp_path), os.path.relpath(tmp_path, there), f"file:{tmp_path}", f"file://{tmp_path}", f"{tmp_path}/"):
        rows = files.read_documents(spark, directory).collect()
        assert sorted(r.text for r in rows) == sorted(everything), directory
        assert {r.doc_type for r in rows} == {"text"}
    # Python has no client for it, so hidden names stay unseen; everything else is read.
    rows = files.read_documents(spark, "viewfs://docs/at").collect()
    assert sorted(r.text for r in rows) == ["text 0", "text 1", "text 4"]
    for absent in (str(tmp_path / "absent"), "absent/relative", "viewfs://docs/at/absent"):
        with pytest.raises(FileNotFoundError, match="Directory not found"):
            files.discover(spark, absent)


def test_hidden_files_beyond_the_limit_are_not_read(spark, tmp_path):
    (tmp_path / "_large.txt").write_text("x" * 500)
    spark.conf.set(files.LENGTH_LIMIT, "100")
    try:
        (row,) = files.discover(spark, str(tmp_path)).select("length", "content").collect()
        assert row.length == 500 and row.content is None
        (row,) = files.read_documents(spark, str(tmp_path)).collect()
        assert (row.status, row.error) == ("failed", "too large to read: 500 bytes")
    finally:
        spark.conf.unset(files.LENGTH_LIMIT)


def archive(pictures):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for name, content in pictures:
            out.writestr(f"word/media/{name}", content)
    return packed.getvalue()


def test_pictures_are_unpacked_one_at_a_time(monkeypatch):
    opened = []
    read = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name: opened.append(name) or read(self, name))
    found = docx_media(archive([(f"{n}.png", b"x") for n in range(5)]))
    next(found)
    assert len(opened) == 1
    assert len(list(found)) == 4


def test_a_broken_picture_is_left_out(spark):
    whole = archive([("a.png", b"first" * 9), ("b.png", b"second" * 9), ("c.png", b"third" * 9)])
    broken = whole.replace(b"second" * 9, b"spoilt" * 9)
    rows = [(1, "x.docx", "docx", broken), (2, "y.docx", "docx", whole), (3, "z.docx", "docx", b"no archive"), (4, "n.docx", "docx", None)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, doc_type string, content binary")
    found = sorted((r.path, r.member) for r in files.explode_docx_media(frame).collect())
    media = [f"word/media/{n}.png" for n in "abc"]
    assert found == [("x.docx", media[0]), ("x.docx", media[2])] + [("y.docx", m) for m in media]


def test_batches_of_pictures_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(files, "MEDIA_BATCH", 100)
    frame = spark.createDataFrame([("x.docx", "docx", archive([(f"{n}.png", bytes([n]) * 40) for n in range(9)]))], "path string, doc_type string, content binary")
    assert files.explode_docx_media(frame).count() == 9


def test_dedupe_keeps_contents_out_of_aggregates_and_sorts(spark):
    rows = [("b", "1", b"x"), ("a", "2", b"x"), ("a", "1", b"x"), ("a", "1", b"x"), ("c", "1", b"y"), ("c", "2", None)]
    unique = assets.dedupe_assets(spark.createDataFrame(rows, "path string, name string, content binary"))
    assert sorted((r.path, r.name, r.content) for r in unique.collect() if r.content) == [("a", "1", bytearray(b"x")), ("c", "1", bytearray(b"y"))]
    assert unique.count() == 3
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "content" in line and ("Aggregate" in line or "Sort" in line)]


def test_the_result_map_is_computed_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    rows = spark.range(50).selectExpr("concat('p', id) AS path", "CAST(id AS STRING) AS text").mapInPandas(count, "path string, text string")
    results.write_result_map(rows.select("path", F.try_parse_json("text").alias("config")), str(tmp_path / "map"))
    parts = sorted((tmp_path / "map").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts)) == {f"p{n}": n for n in range(50)}
    assert computed.value == 50


def drawn(width, height, bits, colour, rows, interlaced=0, cut=None):
    """A PNG with given row data (filter bytes included)."""
    packed = zlib.compress(b"".join(rows))[:cut]
    header = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)
    parts = [(b"IHDR", header), (b"tEXt", b"a note"), (b"IDAT", packed[:5]), (b"IDAT", packed[5:]), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@pytest.mark.parametrize("kind", range(5))
def test_blank_pictures(kind):
    blank = bytes([kind])
    assert not shows_something(drawn(60, 50, 8, 2, [blank + bytes(180)] * 50))
    assert shows_something(drawn(60, 50, 8, 2, [blank + bytes(180)] * 49 + [blank + bytes(179) + b"\x01"]))
    assert not shows_something(drawn(50, 50, 1, 0, [blank + bytes(7)] * 50))
    assert shows_something(drawn(50, 50, 16, 6, [blank + bytes(400)] * 10 + [blank + bytes(7) + b"\x80" + bytes(392)] + [blank + bytes(400)] * 39))
    passes = [blank + bytes(1)] * 1 + [blank + bytes(1)] + [blank + bytes(2)] + [blank + bytes(2)] * 2 + [blank + bytes(4)] * 2 + [blank + bytes(4)] * 4 + [blank + bytes(8)] * 4
    assert not shows_something(drawn(8, 8, 8, 0, passes, interlaced=1))
    assert shows_something(drawn(8, 8, 8, 0, [*passes[:-1], blank + bytes(7) + b"\x01"], interlaced=1))


def test_large_broken_and_other_pictures():
    large = drawn(4000, 4000, 8, 2, [bytes(12001)] * 3999 + [bytes(12000) + b"\x01"])
    assert len(large) < 100_000 and shows_something(large)
    assert not shows_something(drawn(60, 60, 8, 0, [bytes(61)] * 60, cut=8))
    assert not shows_something(b"\x89PNG\r\n\x1a\n") and not shows_something(None)
    assert shows_something(jpeg(60, 60)) and not shows_something(png(60, 60, 0)) and shows_something(png(60, 60))


def test_errors_are_written_with_the_results(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    errors = {"p0": [], "p1": ["Missing required property 'a' at $", "Expected string at $.b, got int"], "p2": ["no decoder for pdf"], "p3": ["Answer 2: not an object"]}
    rows = [(p, "failed" if p == "p2" else "read", None if p == "p2" else "{}", e) for p, e in errors.items()]
    frame = spark.createDataFrame(rows, "path string, status string, text string, errors array<string>").mapInPandas(
        count, "path string, status string, text string, errors array<string>")
    done = frame.select("path", "status", F.try_parse_json("text").alias("config"), "errors")
    results.write_with_quarantine(done, str(tmp_path / "out"))
    assert computed.value == 4
    found = sorted((r.path, r.kind, r.error) for r in results.read_quarantine(spark, str(tmp_path / "out")).collect())
    assert found == [("p1", "missing_property", errors["p1"][0]), ("p1", "wrong_type", errors["p1"][1]),
                     ("p2", "unreadable", errors["p2"][0]), ("p3", "lost_answer", errors["p3"][0])]
    kept = spark.read.parquet(str(tmp_path / "out")).where("kind = 'none'").select("path", "config").collect()
    assert sorted(map(tuple, kept)) == [("p0", "{}"), ("p1", "{}"), ("p2", None), ("p3", "{}")]


def test_pictures_end_to_end(spark, directory):
    """A picture's answer fills what the text leaves open; equal and small pictures ask once or not at all."""
    asked = spark.sparkContext.accumulator(0)

    def look(requests):
        def count(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch
        said = F.when(F.startswith("image_url", F.lit("data:image/jpeg;base64,")), F.lit('{"host": "from-picture", "seen": true}'))
        return requests.select("doc_id", "chunk_id", said.alias("response")).mapInPandas(count, "doc_id string, chunk_id int, response string")

    done = process_directory(spark, directory, answer, spark.createDataFrame([], HISTORY_SCHEMA), SCHEMA, answer_pictures=look)
    found = {name(r["path"]): r["c"] for r in done.select("path", F.to_json("config").alias("c")).collect()}
    assert found["c.docx"] == '{"host":"héllo","seen":true}' and found["a.txt"] == '{"host":"db1.example.org"}'
    assert asked.value == 2
