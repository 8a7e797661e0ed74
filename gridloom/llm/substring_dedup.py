"""Repeated passages by suffix trees over prefix-partitioned, memory-sized groups of suffixes.

1. Prefixes. A window of words is dealt by a gram that it holds: the least by hash of its grams of ``lengths[0]``
   words, so that equal windows are dealt alike and neighbours mostly together (a window minimiser). A gram of which
   one document alone has windows can't lie in a repeat and goes no further; this loses none. A gram with more than
   ``group`` places is too large for one tree: its windows are dealt again by their least gram of the next length,
   and what is still too large at the last length by the whole window. So prefixes lengthen until a group fits.
2. Trees. In a group, the suffixes that start at a window are sorted, and the common prefixes of neighbours computed:
   the suffix tree in array form. A stretch of neighbours whose common prefixes reach ``window`` words is what hangs
   below a deep internal node; of its leaves those go that have a smaller document beside them.
3. Whole windows. A prefix as long as the window is one deep node, of any size. Its least document is a minimum
   combined on the map side and joined back, so its places are never gathered.
4. Marks that overlap or touch join to the maximal repeated passages.

Copies of a whole text take part once, through the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_slices

WINDOW = 13  # words of a repeat, at least
LENGTHS = (4, 8)  # words of a prefix, step by step
GROUP = 4096  # places of a prefix, at most; some MB of text
SLICE = 8 << 20  # bytes of text whose places are packed together
LEAVES = 40_000  # suffixes that are sorted at once, about, beyond one group


#: A fixed pseudo-random value for each byte: two rounds of a multiplicative mix.
MIX = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.arange(1, 257, dtype=np.uint64) * MIX
BYTES ^= BYTES >> np.uint64(31)
BYTES *= np.uint64(0xBF58476D1CE4E5B9)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_list(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Words:
    """The words of some texts in a row: where each begins and ends in ``raw``, its text, and a 64-bit hash."""

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.raw = b"\n".join(parts)
        data = np.frombuffer(self.raw, np.uint8)
        edge = np.diff((~SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), self.start, "right") - 1
        self.hash = np.zeros(len(self.start), np.uint64)
        for k in range(0, len(self.start), 1 << 16):  # eight-byte numbers for each byte, so in pieces
            start, end = self.start[k:k + (1 << 16)], self.end[k:k + (1 << 16)]
            piece = data[start[0]:end[-1]]
            size = end - start
            first = np.cumsum(size) - size
            power = np.cumprod(np.full(int(size.max()), MIX, np.uint64))
            inner = np.arange(int(size.sum())) - np.repeat(first, size)
            self.hash[k:k + (1 << 16)] = mixed(np.add.reduceat(BYTES[piece[~SPACE[piece]]] * power[inner], first))

    def number(self) -> np.ndarray:
        """Of each word, its place in its text."""
        return np.arange(len(self.row)) - np.searchsorted(self.row, self.row)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= MIX
        out += h[k:k + len(out)]
    return mixed(out)


def picks(h: np.ndarray, n: int) -> np.ndarray:
    """For every window of ``n`` grams the place of its least gram (the first of equals)."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, n)
    out = np.empty(len(view), np.int64)
    for k in range(0, len(view), 1 << 16):
        out[k:k + (1 << 16)] = view[k:k + (1 << 16)].argmin(axis=1)
    return out + np.arange(len(out))


def dealt(words: Words, window: int, lengths: tuple[int, ...], live: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, first window, last window, gram, kind) by length: the stretches of windows that come to it and the gram
    that each is dealt by. ``live``: by length the grams within a group and over it; kind says 1 or 2 for these, 0 for
    the rest. What is over it at the last length comes by whole windows, as a level of its own."""
    count = max(0, len(words.row) - window + 1)
    todo = words.row[:count] == words.row[window - 1:]
    for level, n in enumerate(lengths):
        if not todo.any():
            return
        h = grams(words.hash, n)
        p = picks(h, window - n + 1)
        # a gram that two texts share by standing at an edge is in windows of neither
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (todo[1:] != todo[:-1]) | (words.row[1:count] != words.row[:count - 1])])
        last = np.r_[first[1:], len(p)] - 1
        first, last = first[todo[first]], last[todo[first]]
        gram = h.view(np.int64)[p[first]]
        kind = np.zeros(len(gram), np.int8)
        if level < len(live):
            cool, hot = live[level]
            kind = np.isin(gram, cool).astype(np.int8) + 2 * np.isin(gram, hot).astype(np.int8)
        yield level, first, last, gram, kind
        over = np.zeros(count + 1, np.int64)
        over[first[kind == 2]] += 1
        over[last[kind == 2] + 1] -= 1
        todo = np.cumsum(over[:-1]) > 0
    at = np.flatnonzero(todo)
    yield len(lengths), at, at, at, at


def live_grams(batch: pa.RecordBatch, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length: the live grams within a group and over it. Which they are depends on the gram alone, so a slice's
    rows share them."""
    flat = lambda c: np.unique(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    return [(flat(f"cool{k}"), flat(f"hot{k}")) for k in range(levels)]


def lists(levels: int) -> list[str]:
    return [f"{kind}{k}" for k in range(levels) for kind in ("cool", "hot")]


def gram_rows(docs: DataFrame, window: int, lengths: tuple[int, ...]) -> DataFrame:
    """(gram, r, more, places) at the last of ``lengths``: the rows that each gram has windows in (``more`` is null for one
    alone), and how many places it has in all; a slice's rows share a row. ``docs``: (r, text), and the live grams of shorter lengths."""
    level = len(lengths) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            words = Words(b.column("text").to_pylist())
            for at, first, _, gram, _ in dealt(words, window, lengths, live_grams(b, level)):
                if at != level or not len(first):
                    continue
                row = b.column("r").to_numpy(zero_copy_only=False)[words.row[first]]
                order = np.lexsort((row, gram))
                gram, row = gram[order], row[order]
                pair = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
                often = np.diff(np.r_[pair, len(gram)])
                gram, row = gram[pair], row[pair]
                head = np.r_[True, gram[1:] != gram[:-1]]
                rest = np.diff(np.r_[np.flatnonzero(head), len(gram)]) - 1
                more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rest)], pa.int32()), pa.array(row[~head]), mask=pa.array(rest == 0))
                places = np.add.reduceat(often, np.flatnonzero(head))
                yield pa.record_batch([pa.array(gram[head]), pa.array(row[head]), more, pa.array(places, pa.int32())], names=["gram", "r", "more", "places"])

    return docs.select("r", "text", *lists(level)).mapInArrow(run, "gram long, r long, more array<long>, places int")


def with_live_grams(docs: DataFrame, window: int, lengths: tuple[int, ...], group: int) -> DataFrame:
    """``docs`` with cool{k} and hot{k} ARRAY<BIGINT>, the live grams of the last length within their group and over
    it. How many places a gram has is counted on the map side; the rows that have it are listed only if it is live."""
    k = len(lengths) - 1
    rows = gram_rows(docs if k == 0 else docs.where(F.size(f"hot{k - 1}") > 0), window, lengths)
    total = rows.groupBy("gram").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more"))).alias("rows"), F.sum("places").alias("places"))
    known = total.where("rows > 1").select("gram", (F.col("places") > group).alias("hot"))
    listed = rows.select("gram", "r", "more").join(known, "gram").select("gram", "hot", F.concat(F.array("r"), F.coalesce("more", F.array().cast("array<bigint>"))).alias("rs"))
    # dealt before they are listed: partial lists, one or two grams each, would be most of a shuffle
    by_row = listed.select(F.explode("rs").alias("r"), "gram", "hot").repartition("r").groupBy("r")
    mine = by_row.agg(F.collect_set(F.when(~F.col("hot"), F.col("gram"))).alias(f"cool{k}"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias(f"hot{k}"))
    return docs.join(mine, "r", "inner" if k == 0 else "left")


def segments(docs: DataFrame, window: int, lengths: tuple[int, ...]) -> DataFrame:
    """(key, r, doc_id, pos, seg): the stretches of text whose windows were dealt to a group, from word ``pos``. A key
    is a gram within its group's bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            words = Words(b.column("text").to_pylist())
            number, (r, doc) = words.number(), (b.column(c).to_numpy(zero_copy_only=False) for c in ("r", "doc_id"))
            for level, first, last, gram, kind in dealt(words, window, lengths, live_grams(b, len(lengths))):
                pick = np.flatnonzero(kind == 1) if level < len(lengths) else ()
                for k in range(0, len(pick), 20_000):
                    at = pick[k:k + 20_000]
                    f, row = first[at], words.row[first[at]]
                    seg = [words.raw[x:z] for x, z in zip(words.start[f].tolist(), words.end[last[at] + window - 1].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(gram[at]), pa.array(r[row]), pa.array(doc[row]), pa.array(number[f], pa.int32()), pa.array(seg, pa.binary())], names=["key", "r", "doc_id", "pos", "seg"])

    return docs.select("r", "doc_id", "text", *lists(len(lengths))).mapInArrow(run, "key long, r long, doc_id long, pos int, seg binary")


def nodes(docs: DataFrame, window: int, lengths: tuple[int, ...]) -> DataFrame:
    """(path, least, slice, places ARRAY<STRUCT<r, doc_id, pos>>): the whole windows whose grams are too large at every
    length, by a 128-bit hash of their words; a slice's places share a row, and ``least`` is its least document."""
    kinds = [pa.field("r", pa.int64()), pa.field("doc_id", pa.int64()), pa.field("pos", pa.int32())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            words = Words(b.column("text").to_pylist())
            number, (r, doc) = words.number(), (b.column(c).to_numpy(zero_copy_only=False) for c in ("r", "doc_id"))
            found: dict[bytes, list[int]] = {}
            for level, first, _, _, _ in dealt(words, window, lengths, live_grams(b, len(lengths))):
                for k in first.tolist() if level == len(lengths) else ():
                    text = b" ".join(words.raw[words.start[k]:words.end[k + window - 1]].split())
                    found.setdefault(hashlib.blake2b(text, digest_size=16).digest(), []).append(k)
            paths = [*found]
            for k in range(0, len(paths), 5_000):
                part = paths[k:k + 5_000]
                at = np.concatenate([found[p] for p in part])
                ends = np.cumsum([0, *(len(found[p]) for p in part)])
                row = words.row[at]
                cells = pa.StructArray.from_arrays([pa.array(r[row]), pa.array(doc[row]), pa.array(number[at], pa.int32())], fields=kinds)
                least = np.minimum.reduceat(doc[row], ends[:-1])
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array(least), pa.array(np.full(len(part), r[0])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names=["path", "least", "slice", "places"])

    return docs.select("r", "doc_id", "text", *lists(len(lengths))).mapInArrow(run, "path binary, least long, slice long, places array<struct<r:long,doc_id:long,pos:int>>")


def common_prefixes(leaves: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many leading columns each row of ``leaves`` shares with the row before it; none across keys."""
    differ = np.c_[leaves[1:] != leaves[:-1], np.ones(max(0, len(leaves) - 1), bool)]
    return np.r_[0, np.where(key[1:] == key[:-1], differ.argmax(axis=1), 0)][:len(leaves)]


def suffix_tree_marks(rows: list[tuple[int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(r, doc, pos, n): runs of n suffixes, from word pos on, below a deep node that has a smaller document.

    ``rows``: (key, r, doc, pos, segment) of whole groups. Words are numbered and the suffixes of each group sorted
    by them; the common prefixes of neighbours say where a node as deep as the window begins and ends.
    """
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in seg.split()] for *_, seg in rows]
    size = np.array([len(w) for w in words])
    flat = np.concatenate([np.array(w, np.int32) for w in words])
    count = size - window + 1
    own = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + inner
    leaves = flat[start[:, None] + np.arange(window)]
    key, doc = np.array([x[0] for x in rows])[own], np.array([x[2] for x in rows])[own]
    order = np.lexsort((*leaves.T[::-1], key))
    deep = common_prefixes(leaves[order], key[order]) >= window
    node = np.flatnonzero(~deep)
    least = np.repeat(np.minimum.reduceat(doc[order], node), np.diff(np.r_[node, len(order)]))
    hit = np.zeros(len(order), bool)
    hit[order] = doc[order] > least
    begin = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (own[1:] != own[:-1])])
    end = np.flatnonzero(hit & np.r_[~hit[1:] | (own[1:] != own[:-1]), True])
    return [(rows[own[a]][1], rows[own[a]][2], rows[own[a]][3] + int(inner[a]), int(z - a) + 1) for a, z in zip(begin.tolist(), end.tolist(), strict=True)]


def tree_marks(found: DataFrame, window: int) -> DataFrame:
    """(r, doc_id, pos, n): runs of suffixes that repeat an earlier document; a partition's groups stream by."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        leaves, now = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if held and (marks := suffix_tree_marks(held, window)):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*marks, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["r", "doc_id", "pos", "n"])
            held.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "r", "doc_id", "pos", "seg")), strict=True):
                if row[0] != now and leaves > LEAVES:
                    yield from close()
                    leaves = 0
                now = row[0]
                held.append(row)
                leaves += len(row[4]) // 16  # about as many as suffixes
        yield from close()

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "r long, doc_id long, pos int, n int")


def runs(found: np.ndarray) -> pa.RecordBatch:
    """(r, doc_id, pos, n): the places in ``found``, of which rows 1 to 3 are r, doc and pos, as runs."""
    r, doc, pos = found[1:, np.lexsort(found[3:0:-1])]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)][:len(r)])
    last = np.r_[first[1:], len(r)] - 1
    n = pos[last] - pos[first] + 1 if len(r) else pos
    return pa.record_batch([pa.array(r[first]), pa.array(doc[first]), pa.array(pos[first], pa.int32()), pa.array(n, pa.int32())], names=["r", "doc_id", "pos", "n"])


def node_marks(found: DataFrame) -> DataFrame:
    """(r, doc_id, pos, n): the places of whole-window nodes that have a smaller document. They go back to their slices
    together, where the windows of a passage join to one run."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        for b in batches:
            cells, count = b.column("places").flatten(), np.diff(b.column("places").offsets.to_numpy())
            parts = [np.repeat(b.column("slice").to_numpy(zero_copy_only=False), count), *(cells.field(c).to_numpy(zero_copy_only=False) for c in ("r", "doc_id", "pos"))]
            held = np.concatenate([held, np.stack([x.astype(np.int64) for x in parts])], axis=1)
            whole = np.searchsorted(held[0], held[0, -1]) if held.shape[1] else 0  # sorted: slices before the last one
            if whole:
                yield runs(held[:, :whole])
                held = held[:, whole:]
        yield runs(held)

    least = found.groupBy("path").agg(F.min("least").alias("low"))
    over = F.filter("places", lambda x: x["doc_id"] > F.col("low"))
    dealt = found.join(least, "path").select("slice", over.alias("places")).where(F.size("places") > 0)
    return dealt.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "r long, doc_id long, pos int, n int")


def repeated_passages(
    docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row with the passages that repeat an earlier document: doc_id, n_words, n_removed, spans
    ARRAY<STRUCT<start, end>>, kept (the words outside the spans, joined by a blank).

    Spans are maximal stretches of words (from 0, end exclusive; words are parted by ASCII white space and
    unchanged) covered by windows of ``window`` words that also start in a document with a smaller id. Windows
    are judged on the input. Null, empty and short texts have none; repeats inside a document, or between rows
    with equal ids, do not count; rows that share an id and have different texts are judged each by its own text;
    rows with a null id neither lose nor mark anything; repeated rows stay, each with the same result; very long
    texts are taken whole; an empty table gives no rows; other columns are not read.
    """
    lengths = tuple(sorted({min(n, window) for n in lengths}))
    # columns that are right as they are stay so: an alias in one plan and not in another would part their exchanges
    own = docs.select(*(
        F.col(c) if c == name and docs.schema[c].dataType.simpleString() == kind else F.col(c).cast(kind).alias(name)
        for c, name, kind in ((id_col, "doc_id", "bigint"), (text_col, "text", "string"))))
    # a row is known by a hash of its id and text; where it decides, the id is compared too
    solid = own.where("doc_id is not null and text is not null").withColumn("r", F.xxhash64("doc_id", "text"))
    same = F.expr("doc_id ^ own_id = 0")  # not a join key: the texts stay dealt by r alone
    # a text's smallest document speaks for its copies: every window of theirs also starts there
    sha = solid.select("r", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    heads = sha.groupBy("sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")).where("rows > 1").select("sha", "head")
    copies = durable(sha.join(heads, "sha").where("head < doc_id").select("r", F.col("doc_id").alias("own_id")).distinct())

    # every reader of the texts takes them from one exchange by r
    kept = solid.join(copies.withColumnRenamed("r", "r_"), (F.col("r") == F.col("r_")) & same, "left_anti")
    for k in range(len(lengths)):
        kept = with_live_grams(kept, window, lengths[:k + 1], group)
    large = nodes(kept.where(F.size(f"hot{len(lengths) - 1}") > 0), window, lengths)
    marks = tree_marks(segments(kept, window, lengths), window).unionByName(node_marks(large))
    by_row = marks.groupBy("r", F.col("doc_id").alias("own_id")).agg(F.collect_set(F.struct("pos", "n")).alias("marks"))
    facts = by_row.select("r", "own_id", "marks", F.lit(False).alias("copy")).union(copies.select("r", "own_id", F.lit(None).cast("array<struct<pos:int,n:int>>"), F.lit(True)))
    joined = solid.join(facts.withColumnRenamed("r", "r_"), (F.col("r") == F.col("r_")) & same, "left").select("doc_id", "text", "marks", "copy")
    rest = own.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast("array<struct<pos:int,n:int>>").alias("marks"), F.lit(False).alias("copy"))
    return cut(joined.union(rest), window)


def cut(dealt: DataFrame, window: int) -> DataFrame:
    """Marks to spans and kept words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            total, gone, spans, kept = [], [], [], []
            for text, marks, copy in zip(*(b.column(c).to_pylist() for c in ("text", "marks", "copy")), strict=True):
                words = word_list(text)
                total.append(len(words))
                hit = np.zeros(len(words) + 1, np.int64)
                if copy:
                    marks = [{"pos": 0, "n": len(words) - window + 1}] if len(words) >= window else []
                for m in marks or ():
                    hit[m["pos"]] += 1
                    hit[m["pos"] + m["n"] - 1 + window] -= 1
                covered = np.cumsum(hit)[:-1] > 0
                gone.append(int(covered.sum()))
                edge = np.diff(np.r_[0, covered.view(np.int8), 0])
                spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return dealt.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
