"""Near copies by exact Jaccard similarity of their word shingles, candidates from MinHash bands.

Texts with the same set of shingles are one class. 32 bands of 4 minima bring two classes together at least once
with a chance of 1 - (1 - s ** 4) ** 32 at similarity s: at 0.8 one pair of twenty million is missed. What meets in a
band is compared by some bits of all its 128 minima, which part what is three standard deviations too far apart (one
pair of seven hundred at 0.8, fewer above), and then by its whole shingle sets. First all members of a band's group are held
against one of them, which joins most of a large group. What its sketch leaves near that one is a family. A family that
is not yet joined is cut into chunks of bounded size, and each pair of chunks is one block, in which every member is
counted against all others at once and only links that join come out: no pair of a family is ever a row. Texts of
different families are joined by their rarest shingles (a prefix filter, which is exact), so texts that meet through one
passage that many share are not held against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, release, text_slices
from .simhash import shingles

BANDS, ROWS = 32, 4
PLANES = 3  # bits of each minimum in a sketch
CHUNK = 1 << 18  # shingles of a chunk of a family, about; a block holds two of them


def hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none for a text without words."""
    of = xxhash.xxh64_intdigest
    found = [np.array([of(s, 42) for s in piece], np.uint64) for piece in shingles(text, words)]
    return np.unique(np.concatenate(found)) if found else np.array([], np.uint64)


def minima(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, bands): a 64-bit hash of each band's minima, and (sets, 2 * PLANES): PLANES bits of every minimum, bit by
    bit, in words of 64; sets aren't empty."""
    rng = np.random.default_rng(115)
    odd, plus = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    low = np.stack([np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts) for a, b in zip(odd, plus, strict=True)], axis=1)
    rows = np.ascontiguousarray(low.reshape(len(sets), BANDS, ROWS))
    bands = np.array([[xxhash.xxh64_intdigest(rows[k, band].tobytes(), band) for band in range(BANDS)] for k in range(len(sets))], np.uint64)
    low = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLANES)
    bits = [np.packbits((low >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for p in range(PLANES)]
    return bands, np.concatenate(bits, axis=1)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(i, h, k, n, bands, sketch) of the rows of (i, h, t) that have words: class, size of the set, hashes by band, some
    bits of each minimum."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", 1 << 18):
            sets = [hashes(t, words) for t in b.column("t").to_pylist()]
            at = [k for k, s in enumerate(sets) if len(s)]
            if not at:
                continue
            sets = [sets[k] for k in at]
            key = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bands, bits = (pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in minima(sets))
            yield pa.record_batch(
                [b.column("i").take(pa.array(at)), b.column("h").take(pa.array(at)), pa.array(key), pa.array([len(s) for s in sets], pa.int64()), bands, bits],
                names=["i", "h", "k", "n", "bands", "sketch"])

    return docs.mapInArrow(run, "i long, h long, k long, n long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(k, s ARRAY<INT>) of rows of (t): the leading 32 bits of the shingles' hashes, half of what is shuffled. Two of
    a pair's shingles fall together by chance once in some 50000 pairs of 300 words, and then count as one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", 1 << 18):
            sets = [hashes(t, words) for t in b.column("t").to_pylist()]
            key = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.record_batch([pa.array(key), pa.array(short, pa.list_(pa.int32()))], names=["k", "s"])

    return docs.select("t").mapInArrow(run, "k long, s array<int>")


def sketch_limit(least: float) -> int:
    """How many of the minima may differ in a sketch: three standard deviations over what a pair at ``least`` has."""
    count, chance = BANDS * ROWS, (1 - least) * (1 - 0.5**PLANES)
    return math.ceil(count * chance + 3 * math.sqrt(count * chance * (1 - chance)))


def alike(a: str, b: str, least: float) -> Column:
    """Whether two sketches, and two sizes, leave a similarity of ``least`` likely; what fails is too far apart."""
    words = BANDS * ROWS // 64
    differ = [reduce(Column.bitwiseOR, [F.col(f"sketch{a}")[p * words + w].bitwiseXOR(F.col(f"sketch{b}")[p * words + w]) for p in range(PLANES)]) for w in range(words)]
    return (sum(map(F.bit_count, differ)) <= sketch_limit(least)) & (F.least(f"n{a}", f"n{b}") >= least * F.greatest(f"n{a}", f"n{b}"))


def joining_links(key: np.ndarray, root: np.ndarray, size: np.ndarray, flat: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of ``key`` whose sets, in ``flat`` one after another, are as similar as ``least``: so many as join all that
    such pairs connect, beyond what ``root`` does already."""
    label = np.unique(root, return_inverse=True)[1]
    word = np.unique(flat, return_inverse=True)[1]
    starts = np.cumsum(size) - size
    out = []
    for i in range(len(key)):
        if (label == label[0]).all():
            break
        mine = np.zeros(word.max() + 1, bool)
        mine[word[starts[i]:starts[i] + size[i]]] = True
        both = np.add.reduceat(mine[word], starts, dtype=np.int64)
        near = (both >= least * (size[i] + size - both)) & (label != label[i])
        for other in np.unique(label[near]):
            out.append((int(key[i]), int(key[np.flatnonzero(near & (label == other))[0]])))
            near &= label != other
            label[label == other] = label[i]
    return out


def family_links(members: DataFrame, sets: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join what is similar within each family of ``members``, (k, n, root, family), beyond its roots.

    A member goes to one chunk, and with it to as many blocks as its family has chunks.
    """
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / chunk).alias("parts"), F.min("root").alias("low"), F.max("root").alias("high"))
    spread = members.join(parts.where("low <> high"), "family").withColumn("c", F.pmod(F.xxhash64("k"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o")
    blocks = spread.select("k", "root", "family", "c", other).select("k", "root", "family", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                all_ = pa.Table.from_batches(held).combine_chunks()
                key, root = (all_.column(c).to_numpy() for c in ("k", "root"))
                s = all_.column("s").chunk(0)
                found = joining_links(key, root, np.diff(s.offsets.to_numpy()), s.flatten().to_numpy(), least)
                if found:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
            held.clear()

        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in ("family", "x", "y")])
            cuts = np.r_[0, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, b.num_rows]
            for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if u == v:
                    continue
                if now != (now := tuple(at[:, u].tolist())):
                    yield from close()
                held.append(b.slice(u, v - u))
        yield from close()
        release()

    dealt = blocks.join(sets, "k").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    return dealt.select("family", "x", "y", "k", "root", "s").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): each document id of a group of near copies with the group's least id, where they differ.

    Two texts link if the Jaccard similarity of their shingle sets is ``least`` or more; groups are connected. Texts
    without words link to none; fewer words than a shingle are one shingle; null ids are in no pair; repeated rows and
    rows of one id are one; long texts are compared whole; an empty table gives no pairs.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    own = durable(signatures(rows, words))
    classes = durable(own.groupBy("k").agg(F.min("i").alias("least"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    facts = lambda x: classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}"))
    spread = classes.select(F.explode("bands").alias("band"), "k")
    groups = spread.groupBy("band").agg(F.count("*").alias("size"), F.min("k").alias("first")).where("size > 1").select("band", "first")
    met = durable(spread.join(groups, "band"))
    one = met.where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct()
    one = durable(one.join(facts("b"), "b").join(facts("a"), "a").where(alike("a", "b", least)).select("a", "b"))
    family = durable(connected_components(one, "a", "b").select(F.col("node").alias("k"), F.col("root").alias("family")))

    texts = rows.join(classes.join(met.select("k").distinct(), "k", "left_semi").select("h"), "h", "left_semi").dropDuplicates(["h"])
    sets = durable(shingle_sets(texts, words).dropDuplicates(["k"]))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole shingle sets are as similar as that."""
        both = F.size(F.array_intersect("sa", "sb"))
        left, right = (sets.select(F.col("k").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        return durable(pairs.join(left, "a").join(right, "b").where(both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b"))

    near = similar(one)
    rooted = lambda x: connected_components(x, "a", "b").select(F.col("node").alias("k"), "root")
    members = family.join(rooted(near), "k", "left").join(classes.select("k", "n"), "k").select("k", "n", F.coalesce("root", "k").alias("root"), "family")
    near = durable(near.union(family_links(durable(members), sets, least)))
    # links stay within families, and those are done. Texts that meet others: of two as similar as that, the rarest
    # shingles of each, so many as may be missing in the other and one more, have one in common. A passage that many
    # share is never among them.
    named = met.drop("first").join(family, "k", "left").select("band", "k", F.coalesce("family", "k").alias("family"))
    apart = named.groupBy("band").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low <> high").select("band")
    open_ = durable(named.join(apart, "band", "left_semi").select("k", "family").distinct())
    tokens = sets.join(open_.select("k"), "k", "left_semi").select("k", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = tokens.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    known = tokens.join(often, "x").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))
    spare = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("xs"))
    rare = known.select("k", F.slice("xs.x", F.lit(1), F.greatest(spare.cast("int"), F.lit(0))).alias("xs")).where(F.size("xs") > 0)
    rare = durable(rare.join(open_, "k").join(classes.select("k", "n", "sketch"), "k").select("*", F.explode("xs").alias("x")))
    left, right = (rare.select("x", *(F.col(c).alias(f"{c}{s}") for c in ("k", "n", "sketch", "family", "xs"))) for s in "ab")
    # a pair comes once, by the least shingle that both have there
    cross = left.join(right, "x").where((F.col("familya") < F.col("familyb")) & alike("a", "b", least) & (F.array_min(F.array_intersect("xsa", "xsb")) == F.col("x")))
    cross = similar(cross.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    roots = rooted(near.union(cross))
    grouped = classes.join(roots, "k", "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("b"))
    of = grouped.join(lowest, "root").select("k", "b")
    return own.select("i", "k").join(of, "k").where("i <> b").select(F.col("i").alias("a"), "b")
