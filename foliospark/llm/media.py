"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

Each task writes the payloads of its own input split to shards of its own in the shared folder, under a
name no other attempt has, and returns their places; the table of places is written through Spark's
committer, so shards of failed attempts are never referred to. A payload that several tasks stored is
then read from its smallest place only. No text is shuffled, and no digest is hot: the places are
reduced by a partial aggregate, and those of hot digests are broadcast.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, join_counted, materialise

#: Bytes after which a task begins another shard, and digests that it remembers to store equal payloads once.
SHARD_BYTES = 128 << 20
SEEN = 200_000
WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The signature and the whole IHDR chunk: what a header-only read fetches.
HEADER_BYTES = 33
#: Payload bytes that one task reads, about.
READ_BYTES = 256 << 20

PLACES = "doc_id bigint, n_bytes bigint, digest binary, shard string, offset bigint, length bigint"
#: Digests are bytes until the result, so that shuffles carry half of their hex digits.
READ = "digest binary, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the UTF-8 text, those bytes and zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The payload as an 8-bit grey image, 64 samples a line."""
    lines = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)  # a filter byte of 0 before each line
    raw[:, 1:] = lines
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height and depth from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def from_png(stored: bytes) -> np.ndarray:
    """The samples of an image made by to_png, as lines; every chunk's checksum is checked."""
    meta, at, data = png_header(stored), 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if raw[:, 0].any():
        raise ValueError("a filter that is not used here")
    return raw[:, 1:]


class Shard:
    """A tar file written front to back; tells where each member's bytes lie."""

    def __init__(self, fs, path: str):
        self.path, self._out, self._at = path, fs.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        for part in (head, data, bytes(-len(data) % 512)):
            self._out.write(part)
        start = self._at + len(head)
        self._at = start + len(data) + -len(data) % 512
        return start

    @property
    def size(self) -> int:
        return self._at

    def close(self) -> None:
        self._out.write(bytes(1024))
        self._out.close()


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _stored(docs: DataFrame, root: str | None, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The stored payloads: (doc_id, n_bytes, digest) of every row, and the place and number of copies of every digest."""
    spark = docs.sparkSession
    root = root or fresh_path(spark, "media")
    fs, base = _filesystem(root)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(root)
        shard, seen = None, {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, data = payload(text.as_py())
                key = hashlib.sha256(data).digest()
                place = seen.get(key)
                if place is None:
                    if shard is None or shard.size >= shard_bytes:
                        if shard is not None:
                            shard.close()
                        shard = Shard(files, f"{folder}/{uuid.uuid4().hex}.tar")
                    media = to_png(data)
                    place = shard.path.rpartition("/")[2], shard.add(f"{key.hex()}.png", media), len(media)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = place
                out.append((doc_id, n, key, *place))
            if out:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in PLACES.split(", ")])
        if shard is not None:
            shard.close()

    stored = materialise(docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(write, PLACES), "places")
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"), F.count(F.lit(1)).alias("copies"))
    return stored.select("doc_id", "n_bytes", "digest"), first.select("digest", F.concat(F.lit(f"{root}/"), "place.shard").alias("shard"), "place.offset", "place.length", "copies")


def store_media(docs: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, digest (sha256 of the payload, 32 bytes), shard, offset and length for every row of docs(doc_id, text, ...), after storing the payloads as PNG members of tar shards below root (a folder that all executors share; default: a new one in spark.checkpoint.dir).

    Null text: empty, a payload of 64 zero bytes. Null doc_id: kept. Repeated rows: a row each, of one
    place. Empty table: no rows. Other columns are ignored. Equal texts have equal places.
    """
    rows, first = _stored(docs, root, shard_bytes)
    return join_counted(rows, materialise(first, "first"), "digest", "copies").select("doc_id", "n_bytes", "digest", "shard", "offset", "length")


def _readers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, object, tuple]]:
    """(digest, offset, length, open shard, (shard, offset, length, further columns)) of each row; a shard is opened once while its rows follow each other."""
    name, source = None, None
    for batch in batches:
        for digest, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shard, offset, length = place[:3]
            if shard != name:
                if source is not None:
                    source.close()
                fs, path = _filesystem(shard)
                name, source = shard, fs.open_input_file(path)
            yield digest, offset, length, source, tuple(place)
    if source is not None:
        source.close()


def _sorted_places(places: DataFrame, *more: str) -> DataFrame:
    """Places by shard and offset, in as many parts as the payloads behind them (not the rows, which are small) make of READ_BYTES."""
    one = places.select("digest", "shard", "offset", "length", *more)
    one = one if more else one.distinct()
    size = places.agg(F.sum("length")).first()[0] or 0
    n = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    return one.repartition(n, "shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")


def media_headers(places: DataFrame) -> DataFrame:
    """digest, width, height, depth of each stored payload, from a read of the first 33 bytes of its range only."""

    schema = pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas = ((digest, png_header(source.read_at(HEADER_BYTES, offset))) for digest, offset, _, source, _ in _readers(batches))
        return _batched(((digest, m["width"], m["height"], m["depth"]) for digest, m in metas), schema)

    return _sorted_places(places).mapInArrow(read, "digest binary, width int, height int, depth int")


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def feature_of(head: dict, lines: np.ndarray) -> str:
    """Shape from the header; mean, deviation and the share of zero samples from the image."""
    counts = sum(np.bincount(lines[at : at + 4096].ravel(), minlength=256) for at in range(0, len(lines), 4096))
    share, level = counts / lines.size, np.arange(256)
    mean = float(share @ level)
    return f"{head['width']}x{head['height']}x{head['depth']};mean={mean:.4f};std={float(share @ (level - mean) ** 2) ** 0.5:.4f};zero={share[0]:.4f}"


def read_media(places: DataFrame, *more: str) -> DataFrame:
    """One row of READ for each digest of places, from its stored bytes: the header by a range read of its own, then the whole image. With names of further columns, places must have no digest twice, and its place and those columns follow."""
    fields = [c.split() for c in READ.split(", ")] + ([["shard", "string"], ["offset", "bigint"], ["length", "bigint"], *([c, places.schema[c].dataType.simpleString()] for c in more)] if more else [])
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for digest, offset, length, source, place in _readers(batches):
            head = png_header(source.read_at(HEADER_BYTES, offset))
            media = source.read_at(length, offset)
            lines = from_png(media)
            data = lines.tobytes()
            yield digest, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).digest(), feature_of(head, lines), *(place if more else ())

    return _sorted_places(places, *more).mapInArrow(lambda batches: _batched(rows(batches), schema), ", ".join(f"{n} {t}" for n, t in fields))


def tar_members(data: bytes) -> list[tuple[str, bytes]]:
    """Members of a shard, by the tar format alone."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return [(m.name, tar.extractfile(m).read()) for m in tar]


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Stores the payload of every row and returns doc_id, n_bytes and the columns of READ and place, read back from the shards."""
    rows, first = _stored(docs, root, SHARD_BYTES)
    media = materialise(read_media(first, "copies"), "media")
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return join_counted(rows, media, "digest", "copies").select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256"), "tail_crc32", "media_bytes", hexed("media_sha256"), "feature", hexed("digest"), "shard", "offset", "length")
