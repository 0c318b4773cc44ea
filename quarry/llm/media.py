"""Media columns: interleaved document sequences with digest-resolved payloads.

``parse_interleaved`` turns HTML into an ordered sequence of text and media
reference structs (position, kind, text, digest, caption).  Media references are
``media:<sha256>`` URLs.  ``resolve`` joins them by digest with a media table, in
which a payload is stored once per digest and task: the join brings the payload's
features, and the payload itself where it has INLINE bytes at most; larger ones
stay in the table, so that they never travel with the documents.  Positions and
captions stay on the reference, so they remain aligned.

Payloads are stored as the 8-bit grey samples of a PNG, 64 samples a row
(lossless); features and inline payloads are computed from the samples read back.

``text_media`` makes such documents of plain texts: every line that is not blank
is a text block; a figure with the whole text as its payload follows the first
block, a figure with the payload's last 64 bytes the last one, each with the
beginning of the block before it as its caption.

Defined results: null text counts as empty (a payload of 64 zero bytes), and a
text without words has no block and null captions; very long texts are one
payload like any other; repeated rows repeat; equal payloads share one digest; an
empty table gives an empty table; other columns are ignored; references to unknown
digests keep their position with null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, gathered, staged, table, utf8_texts

WIDTH = 64
#: Payloads up to this size travel with the references that the join resolves.
INLINE = 64
CAPTION = 80
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_URL = "media:"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)  # a filter byte (none) before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """The samples (rows x width) of a PNG that ``encode_png`` wrote; checks signature and CRCs."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that encode_png does not write")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash of 8 x 8 block means, mean and entropy of the samples."""
    rows = np.linspace(0, len(samples), 9).astype(int)
    cols = np.add.reduceat(samples.astype(np.int64), np.arange(0, WIDTH, WIDTH // 8), axis=1)
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(cols, axis=0)])
    lo, hi = np.minimum(rows[:-1], len(samples) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(samples) - 1) + 1)
    blocks = (total[hi] - total[lo]) / (hi - lo)[:, None]
    bits = np.packbits((blocks > blocks.mean()).ravel()).tobytes().hex()
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    return f"{bits}-{samples.mean():.4f}-{abs(-(share * np.log2(share)).sum()):.4f}"


class _Interleaved(HTMLParser):
    """Collects text runs and media references in document order."""

    BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    MEDIA = frozenset("img audio video source".split())
    SILENT = frozenset("script style template noscript".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None
        self.silent = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add({"kind": "text", "text": text, "digest": None, "caption": None})

    def add(self, item: dict):
        self.items.append(item | {"position": len(self.items)})

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.MEDIA:
            self.flush()
            own = dict(attrs)
            source = own.get("src") or ""
            self.add({"kind": "media", "text": None, "digest": source.removeprefix(_URL) if source.startswith(_URL) else None, "caption": own.get("alt")})
            if self.figure is not None:
                self.figure.append(self.items[-1])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure or ():
                item["caption"] = said or item["caption"]
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_interleaved(html: str) -> list[dict]:
    """Ordered structs: position, kind (text or media), text, digest, caption."""
    parser = _Interleaved()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.items


SEQUENCE_DDL = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def sequences(rows: DataFrame, html: str = "html") -> DataFrame:
    """``rows`` with the parsed sequence in column ``sequence`` instead of the HTML."""
    kept = [c for c in rows.columns if c != html]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + [f"sequence {SEQUENCE_DDL}"])
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parse(batches):
        for batch in batches:
            found = [parse_interleaved(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, type=kind)], names=[*batch.schema.names[:-1], "sequence"])

    return rows.select(*kept, html).mapInArrow(parse, ddl)


def references(rows: DataFrame) -> DataFrame:
    """One row per media reference: the columns of ``rows``, position, digest, caption."""
    kept = [c for c in rows.columns if c != "sequence"]
    media = F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("item")
    return rows.select(*kept, media).select(*kept, F.col("item.position").alias("position"), F.col("item.digest").alias("digest"), F.col("item.caption").alias("caption"))


_FEATURES = pa.schema([
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
_FEATURES_DDL = "digest string, payload_bytes long, payload_sha256 string, payload binary, media_bytes long, media_sha256 string, feature string"


def _read_back(batches):
    for batch in batches:
        out = {f.name: [] for f in _FEATURES}
        for stored in batch.column(1):
            stored = stored.as_py()
            samples = decode_png(stored)
            payload = samples.tobytes()
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["payload"].append(payload if len(payload) <= INLINE else None)
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            out["feature"].append(feature(samples))
        yield arrow_rows(_FEATURES, out | {"digest": batch.column(0)})


def media_features(media: DataFrame) -> DataFrame:
    """One row per digest of a media table (digest, stored), computed from the stored bytes."""
    found = media.select("digest", "stored").mapInArrow(_read_back, _FEATURES_DDL)
    # a table of its own, so that a join can split the rows of a frequent digest
    return staged(found.groupBy("digest").agg(*(F.min(n).alias(n) for n in _FEATURES.names[1:])), "media-features")


def resolve(refs: DataFrame, features: DataFrame, digest: str = "digest") -> DataFrame:
    """Digest join: every reference keeps its row, position and caption."""
    return refs.join(features.withColumnRenamed("digest", digest), digest, "left")


def article(text: bytes, digests: tuple[str, str]) -> str:
    """The HTML of a text: its lines, a figure behind the first and one behind the last."""
    lines = [" ".join(x.split()) for x in text.decode().split("\n")]
    said = [x for x in lines if x]
    parts = [f"<p>{escape(x, quote=False)}</p>" for x in said]
    figures = [f'<figure><img src="{_URL}{d}"><figcaption>{escape(x[:CAPTION], quote=False)}</figcaption></figure>' for d, x in zip(digests, (said[0], said[-1]) if said else ("", ""))]
    return "<article>" + "".join([*parts[:1], figures[0], *parts[1:], figures[1]]) + "</article>"


_REFERENCE = pa.struct([("position", pa.int32()), ("digest", pa.string()), ("caption", pa.string())])
_STORED = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int32()), ("references", pa.list_(_REFERENCE)), ("digest", pa.string()), ("stored", pa.binary())])
_STORED_DDL = "kind string, doc_id long, n_bytes long, n_items int, references array<struct<position:int,digest:string,caption:string>>, digest string, stored binary"


def _store(batches):
    """Each text becomes media entries (once per digest and task) and a document whose parsed sequence refers to them."""
    stored: set[bytes] = set()
    for batch in batches:
        docs = {"n_bytes": [], "n_items": [], "references": []}
        media: dict[str, list] = {"digest": [], "stored": []}
        for text in utf8_texts(batch):
            whole = padded(text)
            digests = []
            for payload in (whole, whole[-WIDTH:]):
                digest = hashlib.sha256(payload)
                digests.append(digest.hexdigest())
                if digest.digest() not in stored:
                    stored.add(digest.digest())
                    media["digest"].append(digest.hexdigest())
                    media["stored"].append(encode_png(payload))
            items = parse_interleaved(article(text, tuple(digests)))
            docs["n_bytes"].append(len(text))
            docs["n_items"].append(len(items))
            docs["references"].append([{k: x[k] for k in ("position", "digest", "caption")} for x in items if x["kind"] == "media"])
        n, m = batch.num_rows, len(media["digest"])
        none = lambda names, k: {x: [None] * k for x in names}
        yield arrow_rows(_STORED, docs | {"kind": ["doc"] * n, "doc_id": batch.column(0)} | none(("digest", "stored"), n))
        yield arrow_rows(_STORED, media | {"kind": ["media"] * m} | none(("doc_id", "n_bytes", "n_items", "references"), m))


def text_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_bytes, n_items, references; media table), both in the shared folder."""
    rows = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = staged(rows.mapInArrow(_store, _STORED_DDL), "media", "kind")
    return both.filter("kind = 'doc'").select("doc_id", "n_bytes", "n_items", "references"), both.filter("kind = 'media'").select("digest", "stored")


def describe(docs: DataFrame) -> DataFrame:
    """A row per document: the features of its whole payload, and its last bytes' CRC from the payload that the second figure resolves to."""
    found, media = text_media(docs)
    features = media_features(media)
    whole, tail = F.col("references")[0], F.col("references")[1]
    refs = found.select(
        "doc_id", "n_bytes", "n_items", whole["digest"].alias("whole"), whole["position"].alias("position"), whole["caption"].alias("caption"),
        tail["digest"].alias("tail"), tail["position"].alias("tail_position"), tail["caption"].alias("tail_caption"),
    )
    refs = resolve(refs, features.select("digest", F.crc32("payload").alias("tail_crc32")), "tail").drop("tail")
    return resolve(refs, features.drop("payload"), "whole").drop("whole")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "tail_position", "tail_caption", "n_items"]
    return describe(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", *names)
