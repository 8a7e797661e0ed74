"""Media columns: lossless storage of payloads as content-defined chunks that equal media share.

A payload becomes a mono 8-bit PCM WAV; a gear hash over its bytes says where chunks end, so equal stretches are
cut alike wherever they stand. Chunk digests are deduplicated by a Spark aggregation (the store: each digest
once), a medium is an ordered list of digests, and joining list and store by digest gives the bytes back, which
are verified against the recorded hash before features are computed from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_slices

UNIT = 64  # bytes that a payload is padded to a multiple of
RATE = 8000
SHORTEST, LONGEST, MASK_BITS = 2048, 1 << 16, 12  # of a chunk, in bytes; about SHORTEST + 2 ** MASK_BITS on average
#: A fixed pseudo-random value for each byte: a multiplicative mix, folded twice.
GEAR = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
GEAR ^= GEAR >> np.uint64(29)
GEAR *= np.uint64(0xBF58476D1CE4E5B9)
GEAR = (GEAR >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def wav(samples: bytes) -> bytes:
    """The stored form: a 44-byte header and one unsigned 8-bit sample a byte."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def samples(media: bytes) -> bytes:
    """The samples of such a WAV; an error if it is another."""
    head = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if head[0] != b"RIFF" or head[2:4] != (b"WAVE", b"fmt ") or head[10] != 8 or head[12] != len(media) - 44:
        raise ValueError("not a mono 8-bit PCM WAV of this library")
    return media[44:]


def gear(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[byte] << age over the last 32 bytes, modulo 2 ** 32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for age in (1, 2, 4, 8, 16):
        h[age:] += h[:-age] << np.uint32(age)
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of a medium's chunks."""
    step, mask = 1 << 22, np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
    places = []
    for k in range(0, len(data), step):
        back = min(k, 32)
        h = gear(data[k - back:k + step])[back:]
        places += (np.flatnonzero((h & mask) == 0) + k + 1).tolist()
    out, last = [], 0
    for p in [*places, len(data)]:
        while p - last > LONGEST:
            last += LONGEST
            out.append(last)
        if p - last >= SHORTEST:
            out.append(p)
            last = p
    if last < len(data):
        out.append(len(data))
    return out


def pieces(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of a medium's chunks, in order."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(hashlib.blake2b(x, digest_size=16).digest(), x) for x in parts]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, medium, t): medium is a text's hash; rows with equal texts share their medium."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("medium"), t.alias("t"))


def stored(own: DataFrame) -> DataFrame:
    """(medium, m STRUCT<n_bytes, whole, chunks ARRAY<STRUCT<digest, z>>>): one row a medium, z under zstd."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        kind = pa.struct([("n_bytes", pa.int64()), ("whole", pa.binary()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("z", pa.binary())])))])
        for b in text_slices(batches, "t"):
            out = []
            for text in b.column("t").to_pylist():
                media = wav(payload(text))
                out.append({"n_bytes": len(text.encode()), "whole": hashlib.sha256(media).digest(), "chunks": [{"digest": d, "z": press.compress(x)} for d, x in pieces(media)]})
            yield pa.record_batch([b.column("medium"), pa.array(out, kind)], names=["medium", "m"])

    made = own.select("medium", "t").mapInArrow(run, "medium binary, m struct<n_bytes:long,whole:binary,chunks:array<struct<digest:binary,z:binary>>>")
    # the filter says what an inner join would infer: so every reader of the bytes shares one exchange
    return made.where("medium is not null").groupBy("medium").agg(F.first("m").alias("m"))


def listed(own: DataFrame) -> DataFrame:
    """(medium, digest): the distinct chunks of each medium, without their bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            rows = [(m, d) for m, t in zip(b.column("medium").to_pylist(), b.column("t").to_pylist(), strict=True) for d in {d for d, _ in pieces(wav(payload(t)))}]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["medium", "digest"])

    return own.select("medium", "t").mapInArrow(run, "medium binary, digest binary").distinct()


def reconstructed(own: DataFrame) -> DataFrame:
    """(medium, m, fetched ARRAY<STRUCT<digest, z>>): stored media whose shared chunks came through the store.

    A chunk in one medium alone stays with its medium's list. Of a shared one, the least medium keeps the bytes;
    the others keep the digest, and get the bytes by joining the store.
    """
    narrow = listed(own)
    shared = narrow.groupBy("digest").agg(F.min("medium").alias("owner"), F.max("medium").alias("other")).where("owner <> other").select("digest", "owner")
    roles = durable(narrow.join(shared, "digest").select("medium", "digest", (F.col("medium") == F.col("owner")).alias("owns")))
    info = roles.groupBy("medium").agg(
        F.collect_list(F.when(F.col("owns"), F.col("digest"))).alias("owned"),
        F.collect_list(F.when(~F.col("owns"), F.col("digest"))).alias("foreign"))
    lists = stored(own).join(info, "medium", "left")
    store = lists.where(F.size("owned") > 0).select(F.explode(F.array_distinct(F.filter("m.chunks", lambda c: F.array_contains("owned", c["digest"])))).alias("c")).select("c.digest", "c.z")
    fetched = (roles.where("not owns").select("medium", "digest").join(store, "digest")
               .groupBy("medium").agg(F.collect_list(F.struct("digest", "z")).alias("fetched")))
    own_bytes = F.transform("m.chunks", lambda c: F.struct(c["digest"].alias("digest"), F.when(~F.coalesce(F.array_contains("foreign", c["digest"]), F.lit(False)), c["z"]).alias("z")))
    m = F.struct(F.col("m.n_bytes").alias("n_bytes"), F.col("m.whole").alias("whole"), own_bytes.alias("chunks"))
    return lists.select("medium", m.alias("m")).join(fetched, "medium", "left")


def feature(x: bytes) -> str:
    """Mean level, root mean square, crossings of the middle and entropy in bits of 8-bit samples, as text."""
    a = np.frombuffer(x, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.signbit(a[1:]) != np.signbit(a[:-1])))
    counts = np.bincount(np.frombuffer(x, np.uint8), minlength=256) / len(a)
    entropy = float(-(counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    return f"mean={a.mean():.4f};rms={np.sqrt((a * a).mean()):.4f};crossings={crossings};entropy={entropy:.4f}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's medium as read back from its chunk list: doc_id, n_bytes, payload BINARY, media_bytes,
    media_sha256, n_chunks, n_fetched, feature.

    Null and empty texts are 64 zero bytes; equal texts, repeated rows too, share one medium and get equal
    values; long texts are stored whole; null ids stay; an empty table gives no rows; other columns are not
    read. A medium whose bytes do not match their recorded hash is an error.
    """
    return joined(docs, id_col, text_col, False)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``media``, with payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) for the payload,
    so that the bytes stay where they were read back."""
    return joined(docs, id_col, text_col, True)


def joined(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shape = "medium binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, payload binary, media_bytes long, media_sha256 string, n_chunks int, n_fetched int, feature string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        names = [c.split()[0] for c in shape.split(", ")]
        for b in batches:
            rows, held = [], 0
            for medium, m, fetched in zip(b.column("medium"), b.column("m"), b.column("fetched"), strict=True):
                got = {x["digest"]: x["z"] for x in fetched.as_py() or ()}
                m = m.as_py()
                raw = b"".join([plain.decompress(got[c["digest"]] if c["z"] is None else c["z"]) for c in m["chunks"]])
                sha = hashlib.sha256(raw)
                if sha.digest() != m["whole"]:
                    raise ValueError("a medium's chunks do not give its bytes back")
                x = samples(raw)
                rows.append((medium.as_py(), m["n_bytes"], len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), None if digest else x, len(raw), sha.hexdigest(), len(m["chunks"]), len(got), feature(x)))
                held += 512 if digest else len(x)
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    own = keyed(docs, id_col, text_col)
    out = reconstructed(own).mapInArrow(run, shape)
    out = out.drop("payload") if digest else out.drop("payload_bytes", "payload_sha256", "tail_crc32")
    return own.select("doc_id", "medium").join(out, "medium").drop("medium")
