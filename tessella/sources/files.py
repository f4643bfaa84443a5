"""Files as sources: one binary scan, one extractor a suffix, labelled sections out."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import store
from ..operators import extraction as E
from ..operators.markup import visible
from . import pdf

SECTIONS = "array<struct<location:string,text:string>>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the supported files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(E.is_supported(F.col("path")))


def html_sections(raw: bytes) -> list[tuple[str, str]]:
    text, sides = visible(raw.decode("utf-8", "ignore"))
    both = "\n\n".join(x for x in (text, sides) if x)
    return [("document", both)] if both else []


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(p) -> str:
    return "".join(n.text or "" if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in p.iter())


def _docx_blocks(container) -> list[str]:
    """Paragraphs and tables of a container in their order; a table in a cell is rendered inside it."""
    out = []
    for child in container:
        if child.tag == f"{_W}p":
            if text := _run_text(child).strip():
                out.append(text)
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join("\n".join(_docx_blocks(c)).split()) for c in r.findall(f"{_W}tc")] for r in child.findall(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append("Table:\n" + "\n".join(" | ".join(r) for r in rows))
    return out


def docx_sections(raw: bytes) -> list[tuple[str, str]]:
    """Body, headers, footers, text boxes and footnotes of a package as labelled sections."""
    found: list[tuple[str, str]] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        names = package.namelist()

        def root(name: str):
            return ElementTree.fromstring(package.read(name))

        body = root("word/document.xml").find(f"{_W}body")
        found.append(("document", "\n".join(_docx_blocks(body))))
        for kind in ("header", "footer"):
            for name in sorted(n for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml")):
                found.append((kind, "\n".join(_docx_blocks(root(name)))))
        boxes = ["\n".join(_docx_blocks(b)) for b in body.iter(f"{_W}txbxContent")]
        found.append(("text boxes", "\n".join(b for b in boxes if b)))
        if "word/footnotes.xml" in names:
            found.append(("footnotes", "\n".join(t for n in root("word/footnotes.xml") if (t := "\n".join(_docx_blocks(n))))))
    return [(label, text) for label, text in found if text.strip()]


def pdf_words(files: DataFrame) -> DataFrame:
    """(path, page, text, x0, x1, top, bottom, error) of PDF files (path, content): a row a word.

    A file that can't be read, or only in part, has one more row that holds an error and no word. A long file leaves its
    task in frames of WORDS_A_FRAME words.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows, error = [], ""
                found = pdf.words(bytes(content))
                while True:
                    try:
                        word = next(found, None)
                    except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                        word, error = None, f"{type(e).__name__}: {e}"[:500]
                    if word is None:
                        break
                    rows.append((path, *word, ""))
                    if len(rows) == WORDS_A_FRAME:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                rows.append((path, None, None, None, None, None, None, error))
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int64"})

    names = ["path", "page", "text", "x0", "x1", "top", "bottom", "error"]
    return files.mapInPandas(read, "path string, page long, text string, x0 double, x1 double, top double, bottom double, error string")


def _lines(words: list[tuple]) -> list[tuple[float, str, float]]:
    """(top, text, bottom) of the lines of a page's words (text, x0, x1, top, bottom)."""
    lines: list[list[tuple]] = []
    for word in sorted((top, x0, bottom, text.strip(" ")) for text, x0, _, top, bottom in words):
        if lines and abs(word[0] - lines[-1][0][0]) <= E.LINE_TOLERANCE:
            lines[-1].append(word)
        else:
            lines.append([word])
    out = [(min(w[0] for w in ws), " ".join(t for _, _, t in sorted((x0, top, t) for top, x0, _, t in ws) if t), max(w[2] for w in ws)) for ws in lines]
    return sorted(line for line in out if line[1])


def _paragraphs(words: list[tuple], page: int) -> list[tuple[str, str]]:
    """What operators.extraction.paragraphs_of says of one page's words."""
    found: list[list[str]] = []
    last = None
    for top, text, bottom in _lines(words):
        if last is None or top - last > E.PARAGRAPH_GAP:
            found.append([])
        found[-1].append(text)
        last = bottom
    return [(f"page {page} paragraph {k}", "\n".join(lines)) for k, lines in enumerate(found, start=1)]


def pdf_paragraphs(raw: bytes) -> Iterator[tuple[str, str]]:
    """(location, text) of the paragraphs of a PDF file's pages in reading order."""
    for page, found in groupby(pdf.words(raw), itemgetter(0)):
        yield from _paragraphs([w[1:] for w in found], page)


def pdf_sections(files: DataFrame) -> DataFrame:
    """(path, sections, error) of PDF files: the paragraphs of their pages in reading order.

    A page's words lie in one task, so lines and paragraphs are made there and no word is shuffled. What was read before
    an error stays. Rows leave a task when their texts come to FRAME_CHARS.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found, error = [], ""
                try:
                    for location, text in pdf_paragraphs(bytes(content)):
                        found.append({"location": location, "text": text.encode("utf-8", "replace").decode()})
                        size += len(text)
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((path, found, error))
                if size > FRAME_CHARS or len(rows) == 500:
                    yield pd.DataFrame(rows, columns=["path", "sections", "error"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "sections", "error"])

    return files.select("path", "content").mapInPandas(read, f"path string, sections {SECTIONS}, error string")


#: Characters of sections in one frame on its way from a task.
FRAME_CHARS = 8 << 20

WORDS_A_FRAME = 20_000

#: Extractors of binary kinds by suffix; PDF files go through the layout operators instead.
EXTRACTORS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {".html": html_sections, ".htm": html_sections, ".docx": docx_sections}


def sections(files: DataFrame, extractors: dict[str, Callable[[bytes], list[tuple[str, str]]]] | None = None) -> DataFrame:
    """(path, sections, error): text and captions natively, PDF words through the layout operators, the rest by extractors.

    A file that can't be read has an error of at most 500 characters and no sections; the others go on. Bytes that are no
    UTF-8 are dropped, or replaced in captions.
    """
    known = EXTRACTORS | (extractors or {})
    kind = E.suffix(F.col("path"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                suffix = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    found, error = ([("document", content.decode("utf-8", "ignore"))] if suffix not in known else known[suffix](content)), ""
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    found, error = [], f"{type(e).__name__}: {e}"[:500]
                out.append((path, [{"location": a, "text": b} for a, b in found if b.strip()], error))
            yield pd.DataFrame(out, columns=["path", "sections", "error"])

    captions = files.where(kind.isin(".srt", ".vtt"))
    # A byte that is no UTF-8 becomes a replacement sign; a strict decoder would end the job.
    said = E.captions(F.expr("make_valid_utf8(cast(content as string))"))
    spoken = captions.select("path", F.filter(F.array(F.struct(F.lit("transcript").alias("location"), said.alias("text"))), lambda s: s.text != "").alias("sections"), F.lit("").alias("error"))
    own = [".srt", ".vtt", *([".pdf"] if ".pdf" not in known else [])]
    rest = files.where(~kind.isin(own)).mapInPandas(extract, f"path string, sections {SECTIONS}, error string")
    out = spoken.unionByName(rest)
    return out.unionByName(pdf_sections(files.where(kind == ".pdf"))) if ".pdf" in own else out


def eval_fixture(spark: SparkSession, path: str) -> DataFrame:
    """(notebook_id, nr, question, expected_filename, expected_substrings) of evaluation files, one JSON object each."""
    schema = "notebook_id bigint, questions array<struct<q:string,expected_filename:string,expected_substrings:array<string>>>"
    found = spark.read.schema(schema).json(path, multiLine=True).select("notebook_id", F.posexplode("questions").alias("p", "q"))
    return found.select("notebook_id", (F.col("p") + 1).alias("nr"), F.col("q.q").alias("question"), "q.expected_filename", F.coalesce("q.expected_substrings", F.array().cast("array<string>")).alias("expected_substrings"))


#: Rows that one task of the keyed sink writes.
SINK_ROWS = 50_000


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the chunks of the sources in `chunks` (source_id, ...); all other sources' chunks stay."""
    write_keyed(chunks, path, "source_id", buckets=buckets)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a sink's present version."""
    return read_keyed(spark, path)


def _in_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, key: str, *, gone: DataFrame | None = None, buckets: int = 64) -> None:
    """Put `rows` in place of all rows of their keys, and take away those of the keys in `gone`; all other rows stay.

    The sink is a folder of versions, each a list of bucket folders. A write reads and merges the buckets that its keys
    fall into, writes those anew beside the old ones and then puts up a list that names them: one small file, made whole
    under another name and renamed, is what switches over. A writer that dies before leaves the old version as it was,
    and readers keep to the version they began with. Of two writers at a time the later list is refused where the store
    refuses to rename onto a file, as HDFS does, and that writer must begin again. Without any key nothing changes. The
    number of buckets is that of the first write; rows without a key are one key's rows.
    """
    spark = rows.sparkSession
    version, buckets, folders = _version(spark, path, buckets)
    new = store.written(rows.withColumn("_bucket", _in_bucket(key, buckets)))
    changed = new.select(key, "_bucket")
    if gone is not None:
        changed = changed.unionByName(gone.select(key).withColumn("_bucket", _in_bucket(key, buckets)))
    touched = [r[0] for r in changed.select("_bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    old = [folders[b] for b in touched if b in folders]
    merged = new
    if old:
        keys = changed.select(F.col(key).alias("_key")).distinct()
        kept = spark.read.parquet(*old).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        merged = new.unionByName(kept, allowMissingColumns=True)
    data = f"{path}/data-{uuid.uuid4().hex}"
    # A bucket is written by as many tasks as its share of the counted rows takes, each with keys of its own.
    tasks = store.tasks_for(merged, SINK_ROWS)
    share = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(-(-tasks // len(touched))))
    merged.withColumn("_folder", F.col("_bucket")).repartition(tasks, "_bucket", share).write.partitionBy("_folder").parquet(data)
    folders |= {b: f"{data}/_folder={b}" for b in touched}
    at, fs = _hadoop(spark, data)
    filled = {f.getPath().getName() for f in fs.listStatus(at)}
    folders = {b: f for b, f in folders.items() if b not in touched or f"_folder={b}" in filled}
    _put_version(spark, path, version + 1, buckets, folders, merged.drop("_bucket").schema.json())


def read_keyed(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "") -> DataFrame:
    """The rows of a sink's present version; with keys, of the buckets alone that these fall into."""
    version, buckets, folders = _version(spark, path, 0)
    if not version:
        raise ValueError(f"nothing was written to {path}")
    some = folders
    if keys is not None:
        asked = {r[0] for r in keys.select(_in_bucket(key, buckets)).distinct().collect()}  # at most the number of buckets
        some = {b: f for b, f in folders.items() if b in asked}
    schema = _schema(spark, path, version)
    return spark.read.schema(schema).parquet(*some.values()) if some else spark.createDataFrame([], schema)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_version(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{number}", wholetext=True).head()[0])


def _version(spark: SparkSession, path: str, buckets: int) -> tuple[int, int, dict[int, str]]:
    """(number, buckets, folder by bucket) of the last version; number 0 where nothing was written."""
    top, fs = _hadoop(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return 0, buckets, {}
    found = _read_version(spark, path, max(numbers))
    return max(numbers), found["buckets"], {int(b): folder for b, folder in found["folders"].items()}


def _schema(spark: SparkSession, path: str, number: int) -> StructType:
    return StructType.fromJson(json.loads(_read_version(spark, path, number)["schema"]))


def _put_version(spark: SparkSession, path: str, number: int, buckets: int, folders: dict[int, str], schema: str) -> None:
    draft, fs = _hadoop(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps({"buckets": buckets, "folders": folders, "schema": schema}).encode())
    out.close()
    target, _ = _hadoop(spark, f"{path}/versions/{number}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by another")


def append_events(events: DataFrame, path: str) -> bool:
    """Append event rows; a failure is reported, never raised into the caller's flow."""
    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001 - telemetry must not break what it watches
        return False
