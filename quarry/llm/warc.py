"""WARC records in seekable Zstandard bundles.

A bundle holds independent frames of whole records, then a skippable frame that maps record identifiers to (frame,
offset in the frame, length), then the footer seek table of the seekable format, so one record is read by decompressing
one frame.  Bundles are rows (bundle, names, content) of a table that Spark writes to the shared folder, so no executor needs a
local path; ``content`` is a complete ``.warc.zst`` file, ``names`` its identifiers.  ``lookup`` finds bundles by the names alone, and
then opens those and of each the frames that hold what is asked for.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id is the response and the
others revisit it.

Defined results: null html is an empty payload; a null url is an empty target; rows that repeat the response's id are
responses too; rows with a null id revisit if their payload has a response with an id, else are responses; an empty
table writes no bundle; extra columns are ignored.  Control characters in a url are percent-encoded in the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Raw bytes after which a frame and a bundle are closed (a record is never split).
FRAME_BYTES, BUNDLE_BYTES = 128_000, 2_000_000
LEVEL = 3
#: Digests of repeated payloads that may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(name: str) -> int | None:
    found = name[len("<urn:page:") : -1]
    return None if found == "none" else int(found)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Target-URI", target),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + payload + b"\r\n\r\n"


class Bundle:
    """Collects records into frames."""

    def __init__(self):
        self.frames, self.sizes, self.index = [], [], []
        self.open, self.length, self.total = [], 0, 0

    def add(self, name: str, raw: bytes) -> None:
        self.index.append((name, len(self.sizes), self.length, len(raw)))
        self.open.append(raw)
        self.length += len(raw)
        self.total += len(raw)
        if self.length >= FRAME_BYTES:
            self.close()

    def close(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            frame = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(raw)
            self.frames.append(frame)
            self.sizes.append((len(frame), len(raw)))
            self.open, self.length = [], 0

    def content(self) -> bytes:
        self.close()
        index = zstandard.compress(json.dumps(self.index).encode(), LEVEL)
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table


class Reader:
    """Random access to a bundle."""

    def __init__(self, content: bytes):
        n, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        at = len(content) - 9 - 8 * n
        self.content, self.frames, start = content, [], 0
        for k in range(n):
            size, raw = struct.unpack_from("<II", content, at + 8 * k)
            self.frames.append((start, size, raw))
            start += size
        _, length = struct.unpack_from("<II", content, start)
        self.index = json.loads(zstandard.decompress(content[start + 8 : start + 8 + length]))

    def frame(self, k: int) -> bytes:
        start, size, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.content[start : start + size], max_output_size=raw) if raw else b""

    def records(self):
        last, raw = -1, b""
        for name, frame, offset, length in self.index:
            if frame != last:
                last, raw = frame, self.frame(frame)
            yield name, raw[offset : offset + length]

    def get(self, name: str) -> bytes:
        """The first record of an identifier, through its frame alone."""
        for _, raw in self.select({name}):
            return raw
        raise KeyError(name)

    def select(self, names: set[str]):
        """The records of identifiers, all of those that occur more than once, through their frames alone."""
        last, whole = -1, b""
        for name, frame, offset, length in self.index:
            if name in names:
                if frame != last:
                    last, whole = frame, self.frame(frame)
                yield name, whole[offset : offset + length]


def parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _deduplicated(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    base = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    # only payloads that repeat have records that refer to another; the others need not be sent anywhere
    keeper = base.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper")
    keeper = common.checkpoint(keeper)
    if keeper.count() <= BROADCAST_DIGESTS:  # payloads then stay where they are; beyond it they are shuffled
        keeper = F.broadcast(keeper)
    return base.join(keeper, "sha", "left").select("page", "url", "payload", "sha", F.when(~F.col("page").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> str:
    """Write bundles of all pages as a table at ``path``."""

    def pack(batches):
        bundle = Bundle()

        def row(b):
            content = b.content()
            names = list(dict.fromkeys(x[0] for x in b.index))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([names], pa.list_(pa.string())), pa.array([content], pa.binary())], names=["bundle", "names", "content"])

        for batch in batches:
            for page, target, payload, sha, refers in zip(*(batch.column(c) for c in ("page", "url", "payload", "sha", "refers")), strict=True):
                page, refers = page.as_py(), refers.as_py()
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                bundle.add(_name(page), record(page, target.as_py(), payload.as_py(), digest, refers))
                if bundle.total >= BUNDLE_BYTES:
                    yield row(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield row(bundle)

    _deduplicated(pages, page_id, url, html, least).mapInArrow(pack, "bundle string, names array<string>, content binary").write.mode("overwrite").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): one row per record."""

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for _, raw in Reader(content.as_py()).records():
                    head, payload = parse(raw)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind,
                                 _page(head["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return spark.read.parquet(path).select("content").mapInArrow(
        unpack, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def lookup(spark, path: str, ids: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, record_type, record): the whole records of the ids, all rows of an id that occurs more than once; ids without a record have no row."""
    wanted = ids.select(F.coalesce(F.concat(F.lit("<urn:page:"), F.col(page_id).cast("long").cast("string"), F.lit(">")), F.lit(_name(None))).alias("name")).distinct()
    table = spark.read.parquet(path)
    at = table.select("bundle", F.explode("names").alias("name")).join(wanted, "name").groupBy("bundle").agg(F.collect_list("name").alias("asked"))  # reads no content

    def unpack(batches):
        for batch in batches:
            found = [(name, raw) for content, names in zip(batch.column("content"), batch.column("asked"), strict=True) for name, raw in Reader(content.as_py()).select(set(names.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([_page(n) for n, _ in found], pa.int64()), pa.array([parse(r)[0]["WARC-Type"] for _, r in found], pa.string()), pa.array([r for _, r in found], pa.binary())],
                                             names=["page_id", "record_type", "record"])

    return table.select("bundle", "content").join(at, "bundle").select("content", "asked").mapInArrow(unpack, "page_id long, record_type string, record binary")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = write(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(spark, path).drop("payload", "url")


#: The same rows in DuckDB; base 32 goes by groups of five hexadecimal digits.
ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
 b AS (SELECT *, array_to_string(list_transform(generate_series(0, 7), lambda g: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * g, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS digest, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
 SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM b"""
