"""SimHash near-duplicates: fingerprints, links through the anchors of a covering code, components.

Anchors. The 64 bits are cut into blocks of 22, 21 and 21, each padded with zeros to 23 bits, and each block
is covered by the perfect binary Golay code: every word is within radius 3 of exactly one codeword. An anchor
is one codeword per block (36 bits of key). Take fingerprints x and y at distance t = a + b or less and the
point m on a shortest path with d(x, m) <= a and d(m, y) <= b. m's anchor is within 3 of it in every block, so
it is within 3 of x's block plus an excess, the excesses adding up to at most a, and likewise for y and b.
Replicating x to every anchor within covering radius plus its share of the threshold, a, and y likewise with
b, makes each linked pair meet at an anchor at least once: no link is lost. Sharing the threshold between the
sides (1 + 1 for 2 bits) needs about 14 anchors a fingerprint, the whole threshold on one side about 118.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, release, text_slices

GENERATOR = 0b110001110101  # of the binary Golay code of length 23
LENGTH, RADIUS = 23, 3
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width in the fingerprint
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 4 << 20  # bytes of a text that are split into words at once


def shingles(text: str | None, words: int) -> Iterator[list[bytes]]:
    """Lists of the space-joined shingles of a whole text, A-Z lower-cased; long texts come in pieces."""
    data = (text or "").encode().lower()
    held: list[bytes] = []
    start, whole = 0, True
    while start < len(data):
        cut = SPACE.search(data, start + PIECE) if len(data) - start > PIECE else None
        end = cut.start() if cut else len(data)
        held += data[start:end].split()
        start = end
        if len(held) >= words:
            whole = False
            yield [b" ".join(x) for x in zip(*(held[k:] for k in range(words)), strict=False)]
            held = held[len(held) - words + 1:] if words > 1 else []
    if whole and held:
        yield [b" ".join(held)]


def votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits set; runs begin at ``starts`` and aren't empty."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprint_values(texts: Iterable[str | None], words: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: a bit is set if over half of its shingles' XXH64 have it."""
    of = xxhash.xxh64_intdigest
    count, total, out = [], [], []
    held: list[int] = []
    owner: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if held:
            for k, v, n in zip(owner, votes(np.array(held, np.uint64), np.array(starts)), np.diff([*starts, len(held)]), strict=True):
                total[k] += v
                count[k] += n
        held.clear(), owner.clear(), starts.clear()

    for k, text in enumerate(texts):
        count.append(0)
        total.append(np.zeros(64, np.int64))
        for piece in shingles(text, words):
            owner.append(k)
            starts.append(len(held))
            held += map(of, piece, itertools.repeat(42))
            if len(held) > 1 << 16:
                flush()
    flush()
    for n, v in zip(count, total, strict=True):
        out.append(np.packbits(2 * v > n, bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp BIGINT) for every row. A text without words, or null, has fingerprint 0."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            fp = fingerprint_values(b.column("t").to_pylist(), words).view(np.int64)
            yield pa.record_batch([b.column("i"), pa.array(fp)], names=["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@cache
def patterns(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns that lead from a word to codewords: within the radius (excess 0) or at radius + excess.

    (first, count) by syndrome into the list of patterns.
    """
    weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
    found = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(LENGTH), w)])
    s = syndromes(found)
    count = np.bincount(s, minlength=2048)
    return np.cumsum(count) - count, count, found[np.argsort(s, kind="stable")]


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, anchor): every anchor whose excesses over the blocks add up to ``reach`` at most."""
    positions, keys = [], []
    for excesses in itertools.product(range(reach + 1), repeat=len(BLOCKS)):
        if sum(excesses) > reach:
            continue
        at, key = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for (low, width), e in zip(BLOCKS, excesses, strict=True):
            first, count, found = patterns(e)
            word = (fps[at] >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
            s = syndromes(word)
            n = count[s]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code = np.repeat(word, n) ^ found[np.repeat(first[s], n) + inner]
            at, key = np.repeat(at, n), np.repeat(key, n) << 12 | code >> 11
        positions.append(at)
        keys.append(key)
    return np.concatenate(positions), np.concatenate(keys)


def replicas(fps: DataFrame, reach: int) -> DataFrame:
    """(anchor, fp): each fingerprint at each of its anchors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 2048 >> 2 * reach  # some ten thousand rows at once
        for b in batches:
            for k in range(0, b.num_rows, step):
                fp = b.column(0).slice(k, step).to_numpy(zero_copy_only=False)
                at, key = anchors(fp.view(np.uint64), reach)
                yield pa.record_batch([pa.array(key), pa.array(fp[at])], names=["anchor", "fp"])
        release()

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints that differ in at most ``max_bits`` bits.

    ``fps`` has distinct values, so copies take part once. A pair may appear once per shared anchor.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2
    left, right = (replicas(fps, r).select("anchor", F.col("fp").alias(c)) for r, c in ((near, "a"), (far, "b")))
    order = F.col("a") < F.col("b") if near == far else F.col("a") != F.col("b")
    return left.join(right, "anchor").where(order & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(
    docs: DataFrame, words: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the group of documents whose fingerprints link.

    ``words``: shingle length; ``max_bits``: bits in which linked fingerprints may differ (2 of 64 is a
    similarity of 0.97). component_id is the smallest doc_id reachable through links, itself included; null ids
    never name a group (a group of null ids only has null). Texts that are null, empty or without words have
    fingerprint 0 and link like any other; fewer words than a shingle are one shingle; repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """
    own = durable(fingerprints(docs, words, id_col, text_col))
    classes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes, max_bits), "a", "b").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp", "left").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
