"""Media columns: pages as ordered text and media references, with the media in a store of their own keyed by digest.

HTML is parsed into a sequence of structs (position, kind, text or reference, caption) in page order. Payloads are kept
losslessly as 8-bit grey images (binary PGM, 64 samples wide) in a Parquet store that has each of them once, under the digest of
its bytes, and a sequence's references are resolved by a join on the digest; positions and captions stay as parsed.
What is wanted of a payload is computed where it is stored, so that only digests and results are shuffled. Of payloads only
those that occur several times are shuffled, after each task has put equal ones together.

The registered query makes a page of every document: the paragraphs of its text, with the payload's picture in their middle.

Defined results: a null text is an empty payload; a null html has no parts; a reference without a stored payload keeps its row with nulls
(`resolve`); repeated rows each give a row, equal payloads share their digest; other columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from html import escape
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checked, save, table
from vigilake.llm.words import slices

#: Samples in a row of an image; payloads are padded with bytes 0 to a positive multiple of it.
WIDTH = 64

STORE = "digest string, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
PARTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


def to_media(payload: bytes) -> bytes:
    """The payload as a PGM image; its length before padding is in a comment of the header."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(payload), WIDTH, rows) + payload.ljust(rows * WIDTH, b"\0")


def from_media(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, bytes before padding) of such an image."""
    head = re.match(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n", media)
    if not head:
        raise ValueError("not an image of this store")
    size, width, rows = map(int, head.groups())
    return np.frombuffer(media, np.uint8, width * rows, head.end()).reshape(rows, width), size


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread, distinct values and a hash of which of 8 by 8 blocks are above the mean."""
    edges = np.linspace(0, len(samples), 9).astype(int)
    mean = samples.mean()
    bits = [samples[a : max(b, a + 1), 8 * k : 8 * k + 8].mean() >= mean if a < len(samples) else False for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(8)]
    value = int("".join("01"[bool(b)] for b in bits), 2)
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.3f} std={samples.std():.3f} values={np.count_nonzero(np.bincount(samples.ravel(), minlength=256))} hash={value:016x}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches, "text", 2 << 20):
        raw = data.tobytes()
        media = [to_media(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([pa.array([sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], ["digest", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """The store of the texts of docs (text), each payload once: digest, media."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))
    copies = save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    held = checked(copies)
    one = keyed.join(held, "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")).select("text")
    return save(keyed.join(held, "key", "left_anti").select("text").unionByName(one).mapInArrow(_encode, STORE), "media")


def as_page(doc_id: int | None, text: str, digest: str) -> str:
    """A page of a document: its lines as paragraphs, and in their middle the picture of its payload with a caption."""
    lines = [f"<p>{escape(x)}</p>" for x in text.split("\n") if x.strip()]
    name = escape(str(doc_id))
    lines.insert(len(lines) // 2, f'<figure><img src="sha256:{digest}" alt="payload"><figcaption>payload of document {name}</figcaption></figure>')
    return f"<article>{''.join(lines)}</article>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0), batch.column(1), strict=True):
            media = media.as_py()
            samples, size = from_media(media)
            payload = samples.tobytes()
            rows.append((sha256(media).hexdigest(), size, len(payload), sha256(payload).hexdigest(), crc32(payload[-WIDTH:]), len(media), feature(samples)))
            if rows[-1][0] != digest.as_py():
                raise ValueError(f"media {digest.as_py()} is damaged")
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


# fixed values: HTML element names
_MEDIA = frozenset("audio embed img source video".split())
_SKIP = frozenset("head noscript script style template".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code em font i kbd mark q s small span strong sub sup time u var wbr".split())


class _Parts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in _INLINE:
            self.flush()
        given = dict(attrs)
        if tag in _SKIP:
            self.skipped += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and given.get("src"):
            part = {"position": len(self.parts), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt")}
            self.parts.append(part)
            if self.figure is not None:
                self.figure.append(part)

    def handle_endtag(self, tag) -> None:
        if tag not in _INLINE and self.caption is None:
            self.flush()
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for part in self.figure or []:
                part["caption"] = text
            if self.figure is not None and not self.figure:
                self.figure.append({"caption": text})  # the caption stands before its media
            self.caption = None
        elif tag == "figure" and self.figure is not None:
            if self.figure and "kind" not in self.figure[0]:
                for part in self.figure[1:]:
                    part["caption"] = self.figure[0]["caption"]
            self.figure = None

    def handle_data(self, data) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def parts_of(html: str | None) -> list[dict]:
    """The parts of a page in order; a figure's caption goes to its media, else the alternative text."""
    if not html:
        return []
    parser = _Parts()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.parts


_KIND = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def _interleave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in slices(batches, "html"):
        yield pa.record_batch([part.column(0), pa.array([parts_of(x.as_py()) for x in part.column(1)], _KIND)], ["doc_id", "parts"])


def _interleave_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _interleave, of the documents' pages (doc_id, text), which are never stored."""
    for part, data, offsets in slices(batches, "text"):
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        pages = (as_page(i, t.decode(), sha256(to_media(t)).hexdigest()) for i, t in zip(part.column(0).to_pylist(), texts, strict=True))
        yield pa.record_batch([part.column(0), pa.array([parts_of(x) for x in pages], _KIND)], ["doc_id", "parts"])


def interleave(pages: DataFrame) -> DataFrame:
    """pages (doc_id, html) with its sequence: doc_id, parts (position, kind, text, ref, caption)."""
    return pages.select("doc_id", "html").mapInArrow(_interleave, f"doc_id long, parts {PARTS}")


def resolve(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """The media parts of the sequences, one row each, with n_parts and the columns of found (digest, ...) for references `sha256:<digest>`."""
    media = F.filter("parts", lambda x: x["kind"] == "media")
    parts = sequences.select("doc_id", F.size("parts").alias("n_parts"), F.explode(media).alias("part"))
    parts = parts.select("doc_id", "n_parts", F.col("part.position").alias("position"), F.col("part.caption").alias("caption"), F.when(F.startswith("part.ref", F.lit("sha256:")), F.substring("part.ref", 8, 64)).alias("digest"))
    return parts.join(found, "digest", "left")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = save(stored(docs).mapInArrow(_features, FEATURES), "features")
    out = resolve(docs.mapInArrow(_interleave_documents, f"doc_id long, parts {PARTS}"), found)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "n_parts", "caption")


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLE_SQL: dict[str, str] = {}
