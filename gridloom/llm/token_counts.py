"""Token counts of whole texts by a public tokenizer; huge texts in overlapping chunks that are spliced.

Resynchronisation. The tokenizer's pattern looks only forward, and merges never cross a pattern match. So if
a match starts at place p both in a chunk that is known to be in step and in a later chunk that began at an
arbitrary place, everything from p on is the same in both: p is a proven common boundary. The last ``GUARD``
characters of the earlier chunk are not trusted: a match, its lookahead or a special string may be cut there.
If an overlap has no such boundary (one match longer than the overlap), the overlap is doubled; if it has
grown to the whole chunk, the chunk itself is doubled, so even a text that is one match is counted right.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

CHUNK, OVERLAP, GUARD = 1 << 15, 1 << 9, 64  # characters


@cache
def tokenizer(path: str):
    """The tokenizer of a file; with more than one processor the library would start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Chunk:
    """One encoded stretch of a text: where its tokens' pattern matches start."""

    def __init__(self, tok, text: str, start: int, end: int):
        e = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids, self.n = start, end, e.ids, len(e.ids)
        match = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.r_[True, match[1:] != match[:-1]]) if self.n else np.zeros(0, np.int64)
        self.first = first  # index of the first token of each match
        self.at = start + np.array(e.offsets, np.int64).reshape(-1, 2)[first, 0]  # its place in the text


def token_ids(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> Iterator[list[int]]:
    """The ids of a whole text in order, a stretch at a time; memory is bounded by the chunk."""
    if len(text) <= chunk:
        yield tok.encode(text, add_special_tokens=False).ids
        return
    left, done, size = Chunk(tok, text, 0, chunk), 0, chunk  # ``done`` tokens of left precede its splice point
    while left.end < len(text):
        wide = overlap
        while True:
            begin = left.end - wide
            if begin <= (left.at[np.searchsorted(left.first, done)] if done < left.n else left.start):
                size *= 2  # no boundary to trust: take a longer chunk from the same splice point
                start = int(left.at[np.searchsorted(left.first, done)]) if done < left.n else left.start
                left, done = Chunk(tok, text, start, min(len(text), start + size)), 0
                break
            right = Chunk(tok, text, begin, min(len(text), begin + max(size, 2 * wide)))
            common = np.intersect1d(left.at[left.at <= left.end - guard], right.at)
            if len(common):
                p = int(common[-1])
                stop, go = (int(c.first[np.searchsorted(c.at, p)]) for c in (left, right))
                yield left.ids[done:stop]
                left, done, size = right, go, chunk
                break
            wide *= 2
    yield left.ids[done:]


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; no shuffle, memory bounded by batch and chunk.

    ``path``: a tokenizers .json file, readable on every executor. No special tokens are added; special strings
    inside a text count as the library has it by default. A null or empty text has 0 bytes and 0 tokens; null
    ids and repeated rows stay; an empty table gives no rows; other columns are not read. A text may be of any
    length; ``over_limit`` is n_tokens > ``limit``.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in text_slices(batches, "t", 1 << 18):
            texts = [t or "" for t in b.column("t").to_pylist()]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            n = [0] * len(texts)
            for k, e in zip(short, tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
                n[k] = len(e)
            for k in {*range(len(texts))} - {*short}:
                n[k] = sum(map(len, token_ids(tok, texts[k], chunk, overlap)))
            size = pc.fill_null(pc.binary_length(b.column("t")), 0).cast(pa.int64())
            yield pa.record_batch([b.column("i"), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
