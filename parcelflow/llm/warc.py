"""Web archives: write whole-file gzip archives, and normalise them to one gzip member per record with an offset index.

Archives are written and read by tasks through the file system that the shared folder's URI names. A task's file gets a name of its
own and counts only if the task succeeds and hands that name on, so a lost executor leaves at most files that nobody lists.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import core

CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "archive string, offset long, length long, record_id string"


def place(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(text))


def record(page_id: str | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record without the payload."""
    revisit = payload is None
    block = HTTP + (b"" if revisit else payload)
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """(archive, n_records): a WARC file in one gzip stream per partition, with a record for each row of (page_id, url, html).

    Of rows with equal payloads of at least ``min_bytes`` the smallest id is the response and the others revisit it. A null html is an empty
    payload; a null id counts only where there is no other; equal smallest ids are all responses.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    copied = pages.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copied = materialize(copied.select("sha", "first"), "copied")
    rows = pages.join(copied, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "sha", "size", revisit.alias("revisit"),
                       F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first")).cast("string").alias("first"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(folder)
        files.create_dir(path, recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(r.sha)).decode()
                out.write(packer.compress(record(r.page_id, r.url, None if r.revisit else r.payload, r.size, digest, r.first)))
                n += 1
        if out:
            out.write(packer.flush())
            out.close()
            yield pd.DataFrame({"archive": [name], "n_records": [n]})
    return materialize(rows.mapInPandas(write, "archive string, n_records long"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, a chunk at a time; the stream is read once."""
    unpacker = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if out := unpacker.decompress(data, CHUNK):
                yield out
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data, unpacker = unpacker.unused_data, zlib.decompressobj(31)
    if out := unpacker.flush():
        yield out


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their Content-Length; a truncated one raises an error."""
    held = bytearray()
    more = True
    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0 and more:
            chunk = next(chunks, None)
            more = chunk is not None
            seen = max(0, len(held) - 3)
            held += chunk or b""
            end = held.find(b"\r\n\r\n", seen)
        if end < 0:
            if held.strip(b"\r\n"):
                raise ValueError("truncated WARC record")
            return
        size = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
        while len(held) < size:
            chunk = next(chunks, None)
            if chunk is None:
                raise ValueError("truncated WARC record")
            held += chunk
        yield bytes(held[:size])
        del held[:size]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """(archive, offset, length, record_id): each archive of ``source`` inflated once, every record rewritten as a gzip member of its own.

    ``target`` gets the archives and, beside each, ``<archive>.idx`` with the offset, length and record id of its records. A task holds
    one record and a chunk of the stream at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(source)
        to_files, to_path = place(target)
        to_files.create_dir(to_path, recursive=True)
        for batch in batches:
            for name in batch["archive"]:
                rows, new, offset = [], f"{uuid.uuid4().hex}.warc.gz", 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream, \
                        to_files.open_output_stream(f"{to_path}/{new}", compression=None) as out, \
                        to_files.open_output_stream(f"{to_path}/{new}.idx", compression=None) as index:
                    for one in records(inflated(stream)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(one) + packer.flush()
                        out.write(member)
                        rows.append((new, offset, len(member), headers(one[:one.find(b"\r\n\r\n")]).get("warc-record-id", "")))
                        index.write(("%d %d %s\n" % rows[-1][1:]).encode())
                        offset += len(member)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id"])
                            rows = []
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id"])
    n = max(1, archives.count())
    return materialize(archives.select("archive").repartition(n).mapInPandas(run, INDEX), "index")


def read_records(index: DataFrame, folder: str, rows_per_task: int = 2000) -> DataFrame:
    """(archive, offset, page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload): records read at their index entries.

    Entries of one archive that follow each other are read in one task. The payload of a response is checked against its digest.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(folder)
        for batch in batches:
            for archive, entries in batch.groupby("archive", sort=False):
                rows = []
                with files.open_input_file(f"{path}/{archive}") as data:
                    for offset, length in zip(entries["offset"], entries["length"], strict=True):
                        data.seek(offset)
                        one = zlib.decompress(data.read(length), 31)
                        end = one.find(b"\r\n\r\n")
                        head = headers(one[:end])
                        payload = None
                        if head["warc-type"] == "response":
                            payload = one[one.find(b"\r\n\r\n", end + 4) + 4:-4]
                            if f"sha1:{digest_of(payload)}" != head["warc-payload-digest"] or len(payload) != int(head["x-payload-length"]):
                                raise ValueError(f"wrong payload at {offset} of {archive}")
                        rows.append((archive, offset, head.get("x-page-id"), head["warc-type"], head.get("x-refers-to-page-id"), head["warc-target-uri"],
                                     int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), payload))
                yield pd.DataFrame(rows, columns=["archive", "offset", "page_id", "record_type", "refers_to", "url", "payload_bytes",
                                                  "payload_digest", "payload"])
    part = F.floor(F.col("offset") / F.lit(rows_per_task * 1024))
    return index.repartition("archive", part).sortWithinPartitions("archive", "offset").mapInPandas(
        run, "archive string, offset long, page_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as monolithic archives under ``folder``, normalise them, and return what the normalised archives hold.

    One row per page as in ``read_records``, ids in their own type. An empty table writes no archive and gives no rows; repeated rows get
    a record each; other columns are left out.
    """
    rows = core(pages, page_id=id_col, url=url_col, html=html_col)
    kind = rows.schema["page_id"].dataType
    archives = write_monolithic(rows, f"{folder}/monolithic", min_bytes)
    read = read_records(normalise(archives, f"{folder}/monolithic", f"{folder}/members"), f"{folder}/members")
    return read.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
