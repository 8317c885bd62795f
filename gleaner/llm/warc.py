"""WARC archives: writing with segmentation and revisits, and reassembly on reading.

Writing. Each page becomes an HTTP response whose payload travels in chunked transfer framing. Pages with equal
payloads of at least ``revisit_bytes`` bytes are stored once, by the page with the largest id; the others become
``revisit`` records that refer to it. A block longer than ``segment_bytes`` is split: the first part is a ``response``
record with segment number 1, the others are ``continuation`` records that name it as their origin; the last one
gives the total length. Spark's text writer writes the records, one after the other, into many gzipped files in the
shared folder (a record ends in two line ends, which is the writer's row separator).

Reading. Files are read as bytes and parsed by their Content-Length fields, task by task. Whole records go straight
on; parts of segmented records are grouped by origin identifier, ordered by segment number, checked for gaps and
against the total length, and joined; then the chunked framing is undone. A record that fails a check is returned
with ``valid`` false, never dropped.

Null payload: empty. Null url: empty. Null ids: such pages are stored as responses of their own payload group unless
another page of the group has an id. Repeated rows: each gets its record; equal rows that hold the largest id are
all responses. Empty table: an archive without records. Extra columns are ignored. Pages without text still have a
record. A file holds at most as many records as make ``file_bytes`` of pages on average.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

VERSION = "WARC/1.1"
LINE = "\r\n"
ROW_END = LINE * 2
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
RECORD = "path string, at bigint, type string, headers map<string,string>, block binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(text: str, size: int) -> list:
    """The text in pieces of at most ``size`` bytes of UTF-8, cut between characters."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return out


def chunked(payload: str, chunk_bytes: int) -> str:
    framed = [f"{len(p.encode()):x}{LINE}{p}{LINE}" for p in _pieces(payload, chunk_bytes)]
    return "".join([*framed, f"0{LINE}{LINE}"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        begin = end + 2
        if body[begin + size:begin + size + 2] != b"\r\n":
            raise ValueError("chunk without its line end")
        out.append(body[begin:begin + size])
        at = begin + size + 2


def _record(kind: str, record_id: str, block: str, **fields) -> str:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return LINE.join([*head, f"Content-Length: {len(block.encode())}", "", block])


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def records_of(page: dict, segment_bytes: int, chunk_bytes: int) -> list:
    """The records of one page, without the final line ends."""
    payload, url = page["payload"] or "", _one_line(page["url"])
    raw = payload.encode()
    digest = f"sha1:{payload_digest(raw)}"
    own = page["page_id"]
    # the record that others refer to has a name that they can work out; any other name is random, so that equal
    # rows don't share one
    name = f"urn:page:{own}:{page['digest']}" if page["single"] else f"urn:uuid:{uuid.uuid4()}"
    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": digest, "WARC_Page_ID": own}
    if page["refers_to"] is not None:
        block = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {len(raw)}{ROW_END}"
        return [_record("revisit", name, block, **common, Content_Type="application/http; msgtype=response",
                        WARC_Refers_To=f"<urn:page:{page['refers_to']}:{page['digest']}>",
                        WARC_Refers_To_Page=page["refers_to"],
                        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = (f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Transfer-Encoding: chunked{ROW_END}"
             + chunked(payload, chunk_bytes))
    kind = {"Content_Type": "application/http; msgtype=response"}
    parts = _pieces(block, segment_bytes)
    if len(parts) == 1:
        return [_record("response", name, block, **common, **kind)]
    out = [_record("response", name, parts[0], **common, **kind, WARC_Segment_Number=1)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block.encode()) if k == len(parts) else None
        out.append(_record("continuation", f"urn:uuid:{uuid.uuid4()}", part, WARC_Target_URI=url,
                           WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  revisit_bytes: int = 0, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 13,
                  file_bytes: int = 1 << 24) -> str:
    """Write the pages as WARC files into a new folder under the checkpoint folder; returns its path."""
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("rank"),
                        F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).alias("size"))
    same = rows.where(F.col("size") >= revisit_bytes).groupBy("digest", "rank").agg(F.count("*").alias("n"))
    best = (same.groupBy("digest").agg(F.max(F.struct("rank", "n")).alias("top"), F.sum("n").alias("members"))
            .where("members > 1").select("digest", F.col("top.rank").alias("winner"), F.col("top.n").alias("copies")))
    joined = rows.join(best, "digest", "left")
    wins = F.col("rank").eqNullSafe(F.col("winner"))
    told = joined.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("copies").isNotNull() & ~wins, F.col("winner").cast("string")).alias("refers_to"),
        F.coalesce(wins & (F.col("copies") == 1), F.lit(False)).alias("single"))

    def lines(batches):
        for b in batches:
            out, held = [], 0
            for page in b.to_pylist():
                made = records_of(page, segment_bytes, chunk_bytes)
                out += made
                held += sum(map(len, made))
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size, n = pages.agg(F.sum(F.octet_length(payload_col)), F.count("*")).first()
    per_file = max(1, math.floor(file_bytes * n / max(size or 0, 1))) if n else 1
    path = scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    (told.mapInArrow(lines, "value string").write.option("lineSep", ROW_END).option("maxRecordsPerFile", per_file)
     .text(path, compression="gzip"))
    return path


def parse(data: bytes):
    """(place, headers with lower-case names, block) of the records of an archive, gzipped in one or many members or
    not; ValueError if it is broken."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not as long as it says")
        yield at, headers, data[begin:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: file, place, type, headers, block."""
    def run(batches):
        names = ["path", "at", "type", "headers", "block"]
        types = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for at, headers, block in parse(content.as_py()):
                    rows.append((file, at, headers.get("warc-type"), list(headers.items()), block))
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``type``, ``headers`` of the first part, ``block``, and ``valid`` (no gap in the segments, and
    the total length is as told)."""
    number = F.col("headers")["warc-segment-number"].cast("int")
    whole = records.where(number.isNull()).select("type", "headers", "block", F.lit(True).alias("valid"))
    part = records.where(number.isNotNull())
    origin = F.coalesce(F.col("headers")["warc-segment-origin-id"], F.col("headers")["warc-record-id"])
    total = F.col("headers")["warc-segment-total-length"].cast("long")
    grouped = part.groupBy(origin.alias("origin")).agg(
        F.sort_array(F.collect_list(F.struct(number.alias("n"), F.col("block").alias("block")))).alias("parts"),
        F.max(F.when(number == 1, F.struct("type", F.map_entries("headers").alias("h")))).alias("first"),
        F.max(total).alias("total"))

    def join(batches):
        for b in batches:
            blocks, valid = [], []
            for parts, told in zip(b.column(2), b.column(3).to_pylist()):
                parts = parts.as_py()
                block = b"".join(p["block"] for p in parts)
                blocks.append(block)
                valid.append([p["n"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == told)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blocks, pa.binary()), pa.array(valid)],
                                             names=["type", "headers", "block", "valid"])

    told = grouped.select("first.type", F.map_from_entries("first.h").alias("headers"), "parts", "total")
    return whole.union(told.mapInArrow(join, "type string, headers map<string,string>, block binary, valid boolean"))


def pages_of(records: DataFrame) -> DataFrame:
    """Pages from whole records: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload`` (null for
    revisits), ``payload_bytes`` and ``payload_digest`` of the full payload, ``valid``."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                h, valid = dict(r["headers"] or ()), r["valid"] and r["type"] is not None
                told = (h.get("warc-payload-digest") or "").removeprefix("sha1:")
                page, url, refers = h.get("warc-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to-page")
                head, _, body = (r["block"] or b"").partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split(LINE)[1:])}
                payload, size, digest = None, None, told
                try:
                    if r["type"] == "revisit":
                        size = int(fields["content-length"])
                    else:
                        payload = dechunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
                        size, digest = len(payload), payload_digest(payload)
                        valid = valid and (not told or told == digest)
                except (KeyError, ValueError):
                    valid = False
                out.append((page, url, r["type"], refers, payload, size, digest, valid))
            types = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "valid"])

    return records.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload binary, "
                                   "payload_bytes bigint, payload_digest string, valid boolean")
