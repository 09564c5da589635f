"""Media columns: interleaved document sequences.

A page's HTML is parsed into an ordered list of elements, texts and media references, each with its position;
a reference has the caption of its figure. Payloads are stored apart, under the SHA-256 of what they hold, and
a join by digest gives each reference its payload's record; the element keeps its place and caption whether or
not a payload is found. Bytes are kept as grey PNG images, 64 samples of 8 bits to a line, without loss.

Rows: null HTML has no element; a reference that no payload answers stays, with nulls. A caption outside of a figure is text; one
that is not closed ends with its figure. Null text is the empty payload, 64 zero bytes. Every stored row is read back; of
equal payloads one record is joined. Records are kept in a struct, so that their names clash with none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.words import raw, slices

LINE = 64
ELEMENTS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_MARK = b"\x89PNG\r\n\x1a\n"


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of LINE columns; the payload's length is a multiple of LINE."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b""))
    return _MARK + b"".join(struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x)) for name, x in parts)


def from_png(png: bytes) -> bytes:
    """The samples of such a PNG."""
    if png[:8] != _MARK:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(png):
        (n,), name = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("a PNG chunk is damaged")
        if name == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, LINE + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, ref (digest of the padded payload), media (PNG) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = raw(part.column("text"))
            size = np.diff(offsets)
            payloads = [data[a:b].tobytes() + bytes(max(LINE, -(-int(n) // LINE) * LINE) - int(n)) for a, b, n in zip(offsets, offsets[1:], size, strict=False)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(size), "ref": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), "media": pa.array([to_png(p) for p in payloads], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, ref string, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Per row of media (ref, media): what the stored bytes hold when read back, and features of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for png in part.column("media"):
                png = png.as_py()
                payload = from_png(png)
                samples = np.frombuffer(payload, np.uint8)
                share = np.bincount(samples, minlength=256) / len(samples)
                share = share[share > 0]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(png), hashlib.sha256(png).hexdigest(), f"{LINE}x{len(payload) // LINE};mean={samples.mean():.3f};std={samples.std():.3f};bits={abs(-(share * np.log2(share)).sum()):.4f}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([part.column("ref"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("ref", "media").mapInArrow(run, "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


class _Elements(HTMLParser):
    """Texts and media references in order; a figure's caption goes to its references."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.hidden, self.figures, self.caption = [], [], 0, [], None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self):
        if self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            for x in self.out[self.figures[-1] :]:
                if x["kind"] == "media":
                    x["caption"] = caption

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source"):
            ref = dict(attrs).get("src")
            if ref:
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt")})
        elif tag == "figure":
            self.flush()
            self.figures.append(len(self.out))
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = [] if self.figures else None
        elif tag in ("p", "div", "br", "li", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "footer", "header", "ul", "ol", "table", "title"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
        elif tag == "figure" and self.figures:
            self.end_caption()
            self.flush()
            self.figures.pop()
        elif tag in ("p", "div", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "title"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def elements_of(html: str | None) -> list[dict]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.out)]


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and elements (ELEMENTS) of each page."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html):
            yield pa.record_batch({key: part.column(0), "elements": pa.array([elements_of(x.as_py()) for x in part.column(1)], kind)})

    rows = pages.select(key, html)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, elements {ELEMENTS}")


def interleave(parsed: DataFrame, records: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, kind, text, ref, caption and record (a struct of the columns of records, one row to a ref) for every element, by a join on the digest."""
    each = parsed.select(key, F.explode("elements").alias("e")).select(key, "e.*")
    one = records.dropDuplicates(["ref"])
    return each.join(one.select("ref", F.struct(*[c for c in one.columns if c != "ref"]).alias("record")), "ref", "left")


def sequences(interleaved: DataFrame, key: str = "page_id") -> DataFrame:
    """One row to a page: its elements in order, each with its payload's record."""
    kept = F.struct("pos", "kind", "text", "ref", "caption", "record")
    return interleaved.groupBy(key).agg(F.sort_array(F.collect_list(kept)).alias("elements"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's text as the one figure of a page, stored, referenced by digest and resolved again."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.table(store_payloads(docs), "media")
    records = scratch.table(read_media(stored), "records")
    scratch_pages = stored.select("doc_id", "n_bytes", F.concat(F.lit("<figure><img src='"), "ref", F.lit("'><figcaption>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>")).alias("html"))
    pages = scratch.table(parse_pages(scratch_pages.withColumn("page", F.struct("doc_id", "n_bytes")), "page"), "pages")
    scratch.drop("media")
    return interleave(pages, records, "page").where("kind = 'media'").select("page.*", "record.*")
