"""Benchmark decontamination: windows of test items are looked up in every token window of the training texts.

The index of the windows is broadcast in blocks of at most ``block`` windows and BLOCK_BYTES bytes, so what an executor
holds is bounded however large the benchmark is. One block, which is what benchmarks need, is one pass over the rows;
more blocks are one pass each, apart from each other, whose finds are put together by text. A find by hash is verified
against the window's words before it counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, alnum_words, text_slices

WINDOW = 10
BLOCK = 1 << 18  # windows broadcast at once, at most
BLOCK_BYTES = 32 << 20  # of the words of these windows and the ids of their items, at most; an index is some twice as much
MIX = 0x9E3779B97F4A7C15  # odd, so that multiplying keeps all bits


def windows(words: list[bytes], length: int) -> list[bytes]:
    """An item's windows, space-joined: all of ``length`` words, or the whole of a shorter item."""
    if len(words) <= length:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k:k + length]) for k in range(len(words) - length + 1)]


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` word numbers."""
    n = max(0, len(ids) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= np.uint64(MIX)
        out += ids[k:k + n]
    return out


class Index:
    """Windows of test items: known words, hashes by window length, and what verifies a find."""

    def __init__(self, found: dict[bytes, set[str]]):
        self.items = found
        self.number: dict[bytes, int] = {}
        by: dict[int, list[list[int]]] = {}
        for w in found:
            words = w.split()
            by.setdefault(len(words), []).append([self.number.setdefault(x, len(self.number) + 1) for x in words])
        self.hashes = {n: np.unique(np.concatenate([rolled(np.array(x, np.uint64), n) for x in v])) for n, v in by.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Verified occurrences (first word, words) in a text, and the items they come from."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        spans, items = [], set()
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            unknown = np.cumsum(np.r_[0, ids == 0])
            at = np.flatnonzero(unknown[n:] == unknown[:-n])  # all n words occur in some window
            if len(at):
                h = rolled(ids, n)[at]
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for k in at[known[place] == h].tolist():
                    if (of := self.items.get(b" ".join(words[k:k + n]))) is not None:
                        spans.append((k, n))
                        items |= of
        return spans, items


def indexes(benchmark: DataFrame, length: int, block: int, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over bounded blocks of windows; a window of very many items may stand in several."""
    held: dict[bytes, set[str]] = {}
    size = 0
    for row in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).toLocalIterator():
        for w in windows(alnum_words(row[1]), length):
            if (w not in held and len(held) >= block) or size > BLOCK_BYTES:
                yield Index(held)
                held, size = {}, 0
            size += 0 if w in held else len(w)
            ids = held.setdefault(w, set())
            if row[0] is not None and row[0] not in ids:
                ids.add(row[0])
                size += len(row[0])
    yield Index(held)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), cut: bool = False,
) -> DataFrame:
    """Every row with its finds: doc_id, n_words, spans ARRAY<STRUCT<start, end>> (words from 0, merged), items
    ARRAY<STRING> (the ids of items as text, sorted).

    A window is ``length`` consecutive words of an item, or a whole shorter item; words are digits, a-z (A-Z
    lower-cased) and non-ASCII characters. Null and empty texts have no words and no finds; very long texts are taken
    whole; an item without words has no window; an item whose id is null marks words but is not listed; items that
    share a window are all listed; ids may be of any type that has a text; repeated rows stay; empty tables give no
    rows, or rows without finds. ``keep`` names columns to carry along, as k; ``cut`` adds rest, a text with finds
    without them (else null).
    """
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("k") for _ in keep[:1]))
    ended = out.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"), *(F.lit(None).cast("string").alias("rest") for _ in range(cut))).schema
    queue = indexes(benchmark, length, block, item_col, item_text_col)
    index, following = next(queue), next(queue, None)
    share = docs.sparkSession.sparkContext.broadcast
    if following is None:
        return out.mapInArrow(scanner(share(index), out.columns, cut), ended)
    # rows are known by their text, which alone says what is found in it
    key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]
    texts = out.where("text is not null").select("text", *key)
    parts = None
    while index is not None:
        found = texts.mapInArrow(finder(share(index)), "t1 long, t2 long, hits array<int>, items array<string>")
        parts = found if parts is None else parts.union(found)
        index, following = following, next(queue, None)
    listed = parts.groupBy("t1", "t2").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    joined = out.withColumns({"t1": key[0], "t2": key[1]}).join(listed, ["t1", "t2"], "left").drop("t1", "t2")
    return joined.mapInArrow(scanner(None, out.columns, cut), ended)


def finder(shared):
    """A function over batches of (text, t1, t2): the rows with finds of one index block."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in text_slices(batches, "text"):
            found = [index.scan(alnum_words(t)) for t in b.column("text").to_pylist()]
            at = pa.array([k for k, (spans, _) in enumerate(found) if spans], pa.int64())
            hits = [[x for s in sorted(spans) for x in s] for spans, _ in found if spans]
            items = [sorted(of) for spans, of in found if spans]
            yield pa.record_batch([b.column("t1").take(at), b.column("t2").take(at), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["t1", "t2", "hits", "items"])

    return run


def scanner(shared, own: list[str], cut: bool):
    """A function over batches that finds windows of the one index block, or takes the hits and items that the rows
    have, counts words, merges spans, and cuts them out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            hits, items, count = [], [], []
            texts = b.column("text").to_pylist()
            if shared is None:
                hits = [h or [] for h in b.column("hits").to_pylist()]
                items = [sorted(x or ()) for x in b.column("items").to_pylist()]
            for text in texts:
                words = alnum_words(text)
                count.append(len(words))
                if shared is not None:
                    spans, of = shared.value.scan(words)
                    hits.append([x for s in spans for x in s])
                    items.append(sorted(of))
            spans = [[{"start": s, "end": e} for s, e in merged(h)] for h in hits]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            rest = [pa.array([without(t, s) if s else None for t, s in zip(texts, spans, strict=True)], pa.string())] * cut
            yield pa.record_batch([*(b.column(c) for c in own), pa.array(count, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), *rest], names=[*own, "n_words", "spans", "items", *["rest"] * cut])

    return run


def merged(hits: list[int]) -> list[list[int]]:
    """Disjoint (start, end) stretches, in order, of alternating first words and word counts."""
    out: list[list[int]] = []
    for s, n in sorted(zip(hits[::2], hits[1::2], strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return out


def hit_words(found: DataFrame) -> DataFrame:
    """``find_hits`` rows with n_hit: how many words lie inside an occurrence."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", total)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, **options) -> DataFrame:
    """``docs`` without benchmark passages, same columns: hit spans are cut out of a text, and a document of
    which over ``max_share`` of the words are hit goes altogether.

    A cut takes the characters from the first hit word's start to the last one's end. Texts without a find are
    unchanged, nulls and empties included; null ids and repeated rows stay; very long texts are taken whole; an empty
    table gives no rows; ``n_chars``, where present, follows a changed text.
    """
    kind, name = docs.schema, options.get("text_col", "text")
    others = tuple(c for c in docs.columns if c != name)
    found = hit_words(find_hits(docs, benchmark, keep=others, cut=True, **options)).where(
        F.col("n_hit") <= F.lit(max_share) * F.col("n_words"))
    put = {name: F.coalesce("rest", "text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("rest").isNotNull(), F.length("rest").cast("long")).otherwise(F.col("k.n_chars"))
    return found.select(*(put[c].cast(kind[c].dataType).alias(c) if c in put else F.col(f"k.`{c}`").alias(c) for c in docs.columns))


def without(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    return cut_words(raw, raw.translate(WORD_TABLE), spans).decode()


def cut_words(raw: bytes, plain: bytes, spans: list[dict]) -> bytes:
    """``raw`` without the stretches of its words in ``spans``; ``plain`` is ``raw`` with blanks for separators."""
    at = np.frombuffer(plain, np.uint8) != 32
    edge = np.diff(np.r_[0, at.view(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for s in spans:
        out.append(raw[last:starts[s["start"]]])
        last = ends[s["end"] - 1]
    return b"".join([*out, raw[last:]])
