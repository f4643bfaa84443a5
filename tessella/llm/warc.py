"""Web archives in ZIP packages: writing WARC records of pages, and reading them back by byte ranges.

A package holds `archive/data.warc.gz` (one gzip member a record), `indexes/index.cdxj` (a line a record, with its
offset and length) and `datapackage.json`, all stored without further compression. The reader parses the archive's
central directory, reads the index, and fetches records by range; nothing is extracted.

Pages with equal payloads of at least `MIN_REVISIT` bytes are stored once: the largest page_id is the response and the
others are revisit records that refer to it. Which page that is comes from a grouping by digest with partial
aggregation; html is never grouped. Packages are written by the tasks that hold the pages, into the shared folder and
under names of their own, and the manifest has those of successful attempts only, so lost tasks can run again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zipdir
from .common import new_path, small_enough, with_python, written

MIN_REVISIT = 1_000
#: Bytes of records after which a task begins another package, and bytes of neighbouring records read at once.
PACKAGE_BYTES, READ_BYTES = 256 << 20, 4 << 20

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d+)>")


def _clean(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "urn:x-page:unknown")


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; of a revisit's payload only digest and length are kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload stored, and the payload's full length, of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, int(re.search(rb"(?i)content-length: (\d+)", http)[1])


class _Sink:
    """What zipfile needs of a stream that can't seek."""

    def __init__(self, stream):
        self.write, self.close, self.at = self._write, stream.close, 0
        self._out = stream

    def _write(self, data: bytes) -> int:
        self._out.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def _stored(package: zipfile.ZipFile, name: str, data: bytes) -> None:
    with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as out:
        out.write(data)


def write_package(stream, rows: Iterator[tuple], date: str, package_bytes: int = PACKAGE_BYTES) -> int:
    """Write records from rows (page_id, url, payload, digest, refers_to) until package_bytes; how many."""
    index, at = [], 0
    with zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as out:
            for page_id, url, payload, digest, refers_to in rows:
                data = record(page_id, url, payload, digest, refers_to, date)
                out.write(data)
                index.append(f"{_clean(url)} {re.sub(r'\D', '', date)} {json.dumps({'filename': DATA, 'offset': at, 'length': len(data)})}\n")
                at += len(data)
                if at >= package_bytes:
                    break
        _stored(package, INDEX, "".join(sorted(index)).encode())
        _stored(package, PACKAGE, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
    return len(index)


def read_package(f, length: int) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Every record of a package in the order of its bytes: the directory, then the index, then ranges of records."""
    found = zipdir.members(f, length)
    lines = zipdir.read_range(f, zipdir.data_offset(f, found[INDEX]), 0, found[INDEX].size).decode().splitlines()
    spans = sorted((e["offset"], e["length"]) for e in (json.loads(x[x.index("{") :]) for x in lines))
    start, i = zipdir.data_offset(f, found[DATA]), 0
    while i < len(spans):
        first, k = spans[i][0], i
        while k < len(spans) and spans[k][0] + spans[k][1] - first <= max(READ_BYTES, spans[i][1]):
            k += 1
        data = zipdir.read_range(f, start, first, spans[k - 1][0] + spans[k - 1][1] - first)
        for offset, size in spans[i:k]:
            yield parse(data[offset - first : offset - first + size])
        i = k


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page into packages below folder; the manifest (path, bytes, records) as a DataFrame.

    A null html counts as empty, a null id is kept as such. Rows that repeat the response's id and payload are
    responses as well.
    """
    with_python(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    big = keyed.where(F.octet_length("html") >= MIN_REVISIT)
    groups = big.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1 and leader is not null")
    side = small_enough(written(groups.select(F.col("digest").alias("same"), "leader"), "equal"), 80)
    told = keyed.join(side, (F.col("digest") == F.col("same")) & (F.octet_length("html") >= MIN_REVISIT), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))
    # Ids are text on their way through pandas, which makes floats of integers with nulls.
    told = told.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers_to.cast("string").alias("refers_to"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for i, url, text, digest, r in zip(frame["page_id"], frame["url"], frame["html"], frame["digest"], frame["refers_to"], strict=True):
                yield i, url, text.encode("utf-8", "surrogatepass"), digest, r

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        left, made = rows(frames), []
        ahead = next(left, None)
        while ahead is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            # A chain has no close(): a package that ends early leaves the rest of the rows to the next.
            with closing(store.open_output_stream(f"{root}/{name}")) as out:
                n = write_package(out, itertools.chain((ahead,), left), date, package_bytes)
            made.append((f"{folder}/{name}", store.get_file_info(f"{root}/{name}").size, n))
            ahead = next(left, None)
        yield pd.DataFrame(made, columns=["path", "bytes", "records"])

    return written(told.mapInPandas(write, "path string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's digest and length are computed from its payload and must agree with its headers; a revisit's are
    those that its headers keep of the full payload.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        for frame in frames:
            for path in frame["path"]:
                store, inner = fs.FileSystem.from_uri(path)
                out = []
                with store.open_input_file(inner) as f:
                    for headers, payload, size in read_package(f, f.size()):
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"damaged payload in {path}: {headers['WARC-Record-ID']}")
                        own, to = _ID.match(headers["WARC-Record-ID"]), _ID.match(headers.get("WARC-Refers-To", ""))
                        out.append((own and own[1], size, digest, kind, to and to[1], *[payload] * payloads))
                        if len(out) == 500:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    packages = manifest.select("path").repartition(max(1, manifest.count()))
    found = packages.mapInPandas(read, schema)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages into new packages in the shared folder and read every record back."""
    return read_archives(write_archives(pages, new_path(spark, "wacz"), **columns))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
     g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS leader FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM g
"""
