"""Media columns: interleaved sequences of text and media references, with payloads kept by digest.

``encode_media`` turns each text into a page of HTML that refers to its payload by digest, and the payload's stored form: an
8-bit greyscale PNG, 64 samples wide. ``interleave`` parses a page into an ordered array of structs (position,
kind, text, digest, caption); ``resolve`` joins the references with what is known of each digest,
so positions and captions stay aligned with their media. The stored bytes are read back (signature,
checksums and sizes verified) before anything is computed from them.

Equal payloads have one digest. Within a task a payload is written once; what is known of a digest
is written as a small table before the join, so both sides of it are plain exchanges and
adaptive execution can split a digest that a third of all rows share.

Edge cases: a null or empty text is 64 zero bytes. Pages without media give text structs only; unresolved references keep their place
with null payload columns. Malformed HTML is parsed as far as it goes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ids_and_text, ship, slices

WIDTH = 64
PREFIX = "media:sha256/"
SEEN_DIGESTS = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\0" * (WIDTH if not raw else -len(raw) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of a PNG that write_png made."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, size = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + chunk):
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">II", chunk[:8])
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    if size != (WIDTH, len(lines)) or lines[:, 0].any():
        raise ValueError("another layout")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean sample and an average hash over 8 x 8 blocks, in integers throughout."""
    bits, total, count = 0, int(samples.sum(dtype=np.int64)), samples.size
    for rows in np.array_split(samples, 8):
        blocks = rows.reshape(len(rows), 8, WIDTH // 8).sum(axis=(0, 2), dtype=np.int64)
        for block in blocks.tolist():
            bits = bits << 1 | (block * count > total * rows.size // 8)
    return f"mean={total / count:.4f};hash={bits:016x}"


class _Parser(HTMLParser):
    """Text between media becomes one struct; a medium's caption is its figcaption, else its alt or title."""

    _BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 article section tr table figure header footer nav blockquote".split())
    _SKIP = frozenset(("script", "style", "template"))
    _MEDIA = frozenset(("img", "video", "audio", "source", "embed"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.skipped = 0
        self.of_figure: int | None = None
        self.target: int | None = None  # the medium of the open caption
        self.in_figure = False
        self.held: list[str] = []  # captions whose figure has no medium yet
        self.captioned: set[int] = set()

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def _give(self, medium: int, text: str) -> None:
        own = self.out[medium]
        own["caption"] = f"{own['caption']} {text}" if medium in self.captioned else text
        self.captioned.add(medium)

    def _close_caption(self) -> None:
        text = " ".join("".join(self.caption or ()).split())
        if text and self.target is not None:
            self._give(self.target, text)
        elif text and self.in_figure:
            self.held.append(text)
        elif text:
            self.words.append(f" {text} ")
        self.caption = self.target = None

    def end_figure(self) -> None:
        """Close what is open; a caption whose figure has no medium is text."""
        self._close_caption()
        self.words.extend(f" {x} " for x in self.held)
        self.held, self.in_figure = [], False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in self._SKIP:
            self.skipped += 1
        elif tag == "figcaption":
            self._close_caption()
            self.caption, self.target = [], self.of_figure
        elif tag in self._MEDIA and own.get("src"):
            self._flush()
            src = own["src"] or ""
            digest = src.removeprefix(PREFIX) if src.startswith(PREFIX) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            self.out.append({"kind": tag, "text": None, "digest": digest, "caption": own.get("alt") or own.get("title")})
            self.of_figure = len(self.out) - 1
            for text in self.held:
                self._give(self.of_figure, text)
            self.held = []
            if self.caption is not None and self.target is None:
                self.target = self.of_figure
        elif tag in self._BREAKS:
            self.words.append(" ")
        if tag == "figure":
            self.end_figure()
            self.of_figure, self.in_figure = None, True

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.caption is not None:
            self._close_caption()
        elif tag in self._BREAKS:
            self.words.append(" ")
        if tag == "figure":
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.words if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    parser = _Parser()
    parser.feed(page or "")
    parser.close()
    parser.end_figure()
    parser._flush()
    return [{"position": i} | x for i, x in enumerate(parser.out)]


def interleave(pages: DataFrame, key: str) -> DataFrame:
    """(key, sequence) from columns key (long) and html."""
    ship(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_page(x.as_py()) for x in batch.column(1)], kind)], [key, "sequence"])

    return pages.select(F.col(key).cast("long").alias(key), "html").mapInArrow(run, f"`{key}` long, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, caption, digest and the columns of known (one row per digest)."""
    refs = sequences.select(key, F.explode("sequence").alias("s")).where("s.digest is not null").select(key, "s.position", "s.caption", "s.digest")
    return refs.join(known, "digest", "left")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, html, digest, n_bytes, media (null where this task has written the digest before)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                pages, digests, sizes, media = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    payload, n = payload_of(text), len(text.encode())
                    digest = hashlib.sha256(payload + n.to_bytes(8, "little")).hexdigest()  # the same padded bytes may be of two texts
                    media.append(None if digest in seen else write_png(payload))
                    if len(seen) >= SEEN_DIGESTS:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    sizes.append(n)
                    pages.append(f'<article><p>text as samples</p><figure><img src="{PREFIX}{digest}" alt="{html.escape(str(n))} bytes"><figcaption>document {doc_id}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "html", "digest", "n_bytes", "media"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, html string, digest string, n_bytes long, media binary")


_FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(2):
            data = x.as_py()
            samples = read_png(data)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else ([],) * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, what is read back of its payload, its position and caption in the page."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.put(encode_media(docs), "media")
    known = stored.where("media is not null").select("digest", "n_bytes", "media").mapInArrow(_describe, _FEATURES)
    known = scratch.put(known.dropDuplicates(["digest"]), "features")
    out = resolve(interleave(stored.select("doc_id", "html"), "doc_id"), known, "doc_id")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
