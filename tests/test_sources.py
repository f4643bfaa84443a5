import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.operators import markup
from tessella.sources import config, files
from tessella.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    table = "<w:tbl><w:tr>" + cell.format("Name") + cell.format("Age") + "</w:tr><w:tr>" + cell.format("Ann") + cell.format("7") + "</w:tr><w:tr>" + cell.format(" ") * 2 + "</w:tr></w:tbl>"
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p>{table}<w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("hello\xff world".encode("latin-1"))
    (tmp_path / "b.VTT").write_text("WEBVTT\n\nNOTE x\ny\n\n00:01 --> 00:02\n<b>Hi</b>\nHi\n\n12\nBye\n")
    (tmp_path / "c.html").write_text('<html><head><meta name="description" content="About"><style>x</style></head><body><p hidden>no</p><div style="display : none">no<b>no</b></div><p>Yes &amp; more</p><img alt="Pic"><input type="hidden" value="v"><input value="w"></body></html>')
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.exe").write_bytes(b"no")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.sections(files.scan(spark, str(tmp_path))).collect()}
    text = {k: [(s.location, s.text) for s in r.sections] for k, r in rows.items()}
    assert set(text) == {"a.txt", "b.VTT", "c.html", "d.docx", "e.docx", "g.pdf"}
    assert text["a.txt"] == [("document", "hello world")]
    assert text["b.VTT"] == [("transcript", "Hi\nBye")]
    assert text["c.html"] == [("document", "Yes & more\n\nAbout\n[image: Pic]\n[input: w]")]
    assert text["d.docx"] == [("document", "First\nTable:\nName | Age\nAnn | 7\nLast"), ("header", "Head")]
    assert rows["e.docx"].error and not text["e.docx"] and rows["g.pdf"].error


def test_chunk_sink_replaces_only_its_sources(spark, tmp_path):
    """Two sources in one bucket; a writer that dies, or comes second, leaves the version that stands."""
    path = f"file://{tmp_path}/chunks"
    put = lambda rows: files.write_chunks(spark.createDataFrame(rows, "source_id long, text string"), path, buckets=1)
    read = lambda: sorted((r.source_id, r.text) for r in files.read_chunks(spark, path).collect())
    put([(1, "a"), (1, "b"), (2, "b")])
    put([(1, "c")])
    assert read() == [(1, "c"), (2, "b")]
    bad = spark.createDataFrame([(2, "x")], "source_id long, text string").withColumn("text", F.raise_error(F.lit("dies")).cast("string"))
    with pytest.raises(Exception, match="dies"):
        files.write_chunks(bad, path, buckets=1)
    put([])
    assert read() == [(1, "c"), (2, "b")]
    with pytest.raises(RuntimeError, match="another"):
        files._put_version(spark, path, 2, 1, {}, "{}")
    assert read() == [(1, "c"), (2, "b")]


def test_chunk_sink_reads_only_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    files.write_chunks(spark.range(200).select(F.col("id").alias("source_id"), F.lit("t").alias("text")), path, buckets=16)
    _, _, before = files._version(spark, path, 0)
    files.write_chunks(spark.createDataFrame([(5, "new")], "source_id long, text string"), path, buckets=16)
    number, _, after = files._version(spark, path, 0)
    assert number == 2 and len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert files.read_chunks(spark, path).count() == 200 and files.read_chunks(spark, path).where("text = 'new'").count() == 1


def test_one_bad_byte_in_captions(spark):
    rows = spark.createDataFrame([("/a.srt", b"1\n00:01 --> 00:02\nHi \xff there\n"), ("/b.vtt", b"WEBVTT\n\nFine\n")], "path string, content binary")
    got = {r.path: [s.text for s in r.sections] for r in files.sections(rows).collect()}
    assert got == {"/a.srt": ["Hi \ufffd there"], "/b.vtt": ["Fine"]}


def test_append_never_raises(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    assert files.append_events(rows, str(tmp_path / "events"))
    (tmp_path / "file").write_text("x")
    assert not files.append_events(rows, str(tmp_path / "file" / "below"))


def test_config_layers(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[retrieval]\nvector_weight = 0.6\ncandidate_pool_size = 30\n")
    got = config.load_config(str(path), {"TESSELLA_RETRIEVAL_VECTOR_WEIGHT": "0.5"})
    assert (got["retrieval"]["vector_weight"], got["retrieval"]["candidate_pool_size"], got["chunking"]["cjk_target_chars"]) == (0.5, 30, 400)
    with pytest.raises(ValueError):
        config.load_config(None, {"TESSELLA_JOBS_MAX_ATTEMPTS": "many"})
    assert config.fingerprint({"a": 1, "api_key": "x"}) == config.fingerprint({"a": 1, "api_key": "y"})


def test_index_sync_as_a_stream(spark, tmp_path):
    """Three ids in two files are three vectors; a deleted chunk's vector goes, and so does a bucket's last row."""
    path, changes = f"file://{tmp_path}/index", f"{tmp_path}/changes"
    schema = "id long, seq long, deleted boolean"
    jobs.put_index(spark.createDataFrame([("chunk:1",), ("chunk:77",)], "vector_id string"), path)

    def feed(*rows):
        for row in rows:
            spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(changes)
        jobs.sync_index(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(changes), path, f"{tmp_path}/checkpoint")
        return sorted(r.vector_id for r in jobs.read_index(spark, path).collect())

    assert feed([(1, 1, False), (2, 2, False), (3, 3, False)], [(3, 4, False), (1, 5, False), (2, 6, False), (None, 7, False)]) == ["chunk:1", "chunk:2", "chunk:3", "chunk:77"]
    assert feed([(2, 9, False), (2, 10, True), (77, 11, True), (5, 12, True)]) == ["chunk:1", "chunk:3"]
    assert feed([(1, 13, True), (3, 14, True)]) == []
    assert feed([(2, 15, False)]) == ["chunk:2"]


def test_character_references_cut_short_stay():
    """Texts of pages are cut at any place, and the SQL reads whole references alone."""
    assert markup.visible("<p>a&amp</p><p>b&am</p><p>&lt;&notit;&copy=1 &#39;&#39 &amp;lt;</p><!-- & --><img alt='x&ampy'>") == ("a&amp\nb&am\n<&notit;&copy=1 '&#39 &lt;", "[image: x&ampy]")


@pytest.mark.parametrize("name", ["file_sections", "file_source", "file_stream", "pdf_text", "file_chunks"])
def test_files_of_odd_documents_equal_their_sql(spark, tmp_path, duck, same, name):
    """Texts and sources may be null, ids negative, and a file that says nothing has no row."""
    texts = [None, "", " \t\n", "\x1c\x85\xa0 　 ", "​", "﻿", " a \n", "one\n\n two"]
    rows = [(10 * k + kind, t, "en", "s1", 1) for k, t in enumerate(texts) for kind in range(10)]
    rows += [(100 * (1 + k) + kind, "t", "en", s, 1) for k, s in enumerate([None, "<&>\"'"]) for kind in range(10)]
    rows += [(-1 - k, "below nothing", "en", "s1", 1) for k in range(10)] + [(None, "t", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(got, con.execute(catalogue.ORACLES[name]).df())
