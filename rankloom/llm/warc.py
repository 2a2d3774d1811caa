"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every response gives two records that refer to it: a metadata record (application/warc-fields) with the source's HTTP header
lines, status, digests and lengths, and a conversion record with the plain text of its page. Record ids are derived from the
response's id, so that a task that runs again writes the same bytes. Digests are SHA-1 in base 32, as is customary.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.arrowtext import slices
from rankloom.llm.html_text import BLOCKS, EVENT, HEAD, INLINE

RECORD = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("target_uri", T.StringType()),
        ("content_type", T.StringType()), ("content_length", T.LongType()), ("block_digest", T.StringType()), ("source_payload_digest", T.StringType()), ("record", T.BinaryType()),
    )]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def plain_text(page: str) -> str:
    """The text of a whole page, a line per block, without its head, scripts, styles, drawings and other raw elements."""
    if head := HEAD.search(page):
        page = page[: head.start()] + page[head.end() :]
    lines, block, drawn = [], [], 0
    for m in EVENT.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag == "svg":
            drawn = max(drawn - 1, 0) if m["end"] else drawn + (not m["rest"].endswith("/"))
        elif drawn and (tag in BLOCKS or tag == "body"):
            drawn = 0
        if m["text"] is not None:
            block.append("" if drawn else m["text"])
        elif tag not in INLINE:
            lines.append("".join(block))
            block = []
    lines.append("".join(block))
    return "\n".join(x for x in (" ".join(html.unescape(t).split()) for t in lines) if x)


def _one_line(value: str) -> str:
    return " ".join(value.split())


def written(kind: str, record_id: str, fields: list[tuple[str, str | None]], content_type: str, block: bytes) -> bytes:
    """The bytes of one record; fields without a value are left out, and no value breaks its line."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in head if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table: _key, _name, _id, _uri, _date, _header (HTTP), _body. A null body is empty; a null url stays null.

    Such a table has no HTTP header: the one made here has the status, type and length that its page was stored with. ``parse``
    reads records that have their own.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(of(body)).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(key).alias("_key"), F.concat_ws("#", F.lit("response"), of(key), of(url)).alias("_name"), F.lit(None).cast("string").alias("_id"), F.col(url).alias("_uri"), F.lit(date).alias("_date"), header.alias("_header"), F.encode(of(body), "UTF-8").alias("_body")
    )


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields (lower-cased names) and block of every whole record; what is cut off at the end is left out."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines) if c}
        size = fields.get("content-length", "")
        if not size.isdigit():
            at = end
            continue
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        if at <= len(data):
            yield fields, block


def parse(files: DataFrame, key: str, data: str = "record") -> DataFrame:
    """Response records in the bytes of each row (a file, or one record): the columns of ``responses``, with their own ids, dates and HTTP headers.

    A task holds one row's bytes: store one record or a bounded file per row. Other kinds of records, null bytes and cut-off records give nothing.
    """
    names = ["_key", "_name", "_id", "_uri", "_date", "_header", "_body"]
    shape = T.StructType([T.StructField("_key", files.schema[key].dataType), *(T.StructField(n, T.StringType()) for n in names[1:-1]), T.StructField("_body", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows = []
                for fields, block in records(batch.column("data")[i].as_py() or b""):
                    if fields.get("warc-type") == "response":
                        header, _, body = block.partition(b"\r\n\r\n")
                        name = fields.get("warc-record-id")
                        rows.append((name or "", name, fields.get("warc-target-uri"), fields.get("warc-date"), header.decode("latin-1") + "\r\n", body))
                if rows:
                    own = batch.column("_key").take(pa.array([i] * len(rows)))
                    columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), [pa.string()] * 5 + [pa.binary()], strict=True)]
                    yield pa.RecordBatch.from_arrays([own, *columns], names=names)

    return files.select(F.col(key).alias("_key"), F.col(data).alias("data")).mapInArrow(run, shape)


def _text_of(header: str, body: bytes) -> str:
    """A body by the character set that its header names; UTF-8, with replacements, if none or an unknown one."""
    found = re.search(r"(?im)^content-type:.*?charset=[\"']?([^\s\"';]+)", header)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(source: DataFrame, key: str = "page_id") -> DataFrame:
    """The metadata and conversion record of every response row; repeated rows give repeated records, an empty table none.

    Responses without an id of their own get one from their key, url and payload, so that other bodies never share one.
    """

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "_body", 1 << 20):
                keys, out = [], []
                for i, r in enumerate(rows.to_pylist()):
                    body, page = r["_body"], plain_text(_text_of(r["_header"], r["_body"]))
                    payload = digest(body)
                    name = r["_id"] or f"{r['_name']}#{payload}"
                    response = r["_id"] or derived_id(name, "response")
                    status, *lines = r["_header"].split("\r\n")
                    facts = [("http-status", status.split(" ")[1] if " " in status else ""), ("source-payload-digest", payload), ("source-payload-length", str(len(body)))]
                    facts += [("source-block-digest", digest(r["_header"].encode("latin-1", "replace") + b"\r\n" + body)), ("text-length", str(len(page)))]
                    facts += [(f"source-header-{k.strip().lower()}", v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
                    meta = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in facts).encode()
                    for kind, mime, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", page.encode())):
                        own = derived_id(name, kind)
                        fields = [("WARC-Date", r["_date"]), ("WARC-Target-URI", r["_uri"]), ("WARC-Refers-To", response), ("WARC-Source-Payload-Digest", payload)]
                        keys.append(i)
                        out.append((kind, own, response, r["_uri"], mime, len(block), digest(block), payload, written(kind, own, fields, mime, block)))
                columns = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), [pa.string()] * 5 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("_key").take(pa.array(keys)), *columns], names=[key, *RECORD.names])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["_key"].dataType), *RECORD]))


def record_digest(column: str = "record") -> Column:
    return F.sha2(column, 256)
