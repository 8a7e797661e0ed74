"""BPE encoding and decoding with a pair occurrence index over a partition's distinct words.

The words that a batch brings for the first time are laid out as one chain of symbols; an index maps every
adjacent pair to all its places in the chain. A heap gives the active merge ranks in ascending order; applying
a rank joins the pairs that still stand at its places, all at once, and updates the lists of the pairs around
them. Where places overlap (a run of one symbol) every other one is joined. In a vocabulary whose joins may call for
an earlier rank they go from left to right, and an earlier rank comes before the rest, as the one-word-at-a-time rule
would have it. Texts come apart at white space, which no word reaches over; what is between (a chunk) is normalised
and split into words by the vocabulary file's own components, and known chunks come from a bounded cache.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import release, text_slices

CACHE = 1 << 18  # chunks, and words, that a worker remembers at most
PLAIN = regex.compile(r"[!-~]*")  # ASCII that is neither blank nor control
MARKS = {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)}  # ASCII that is neither letter, digit nor blank
BATCH = 2 << 20  # bytes of text whose new words are merged together


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` in a row, and where each begins; the last one's end at last."""
    end = np.cumsum(count)
    at = np.repeat(first - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)
    return flat[at], np.r_[0, end].astype(np.int64)


class Bpe:
    """A vocabulary of the word kind: NFC, white space to a blank, lower case, a split pattern, byte symbols."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.raw_special = [t.encode() for t in self.special]
        if any(t.split() != [t] for t in self.special):
            raise ValueError("a special string with white space inside")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        whole = Tokenizer.from_file(path)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        # by rank: the pair of symbols and what they join to
        self.pair = np.array([(self.ids[a], self.ids[b]) for a, b in model["merges"]])
        self.joined = np.array([self.ids[a + b] for a, b in model["merges"]])
        # pairs by number, for lookups of many at once
        code = self.pair[:, 0] * self.WIDE + self.pair[:, 1]
        self.by_code = np.argsort(code)
        self.codes = code[self.by_code]
        # a symbol appears after the rank that makes it; only then may a rank's places be joined all at once
        made: dict[int, int] = {}
        for rank, new in enumerate(self.joined.tolist()):
            made[new] = max(rank, made.get(new, -1))
        self.ordered = all(max(made.get(a, -1), made.get(b, -1)) < rank for rank, (a, b) in enumerate(self.pair.tolist()))
        self.inner = np.array([self.ids[c] for c in self.alphabet])
        self.final = np.array([self.ids[c + self.end] for c in self.alphabet])
        self.forget()

    WIDE = 1 << 20

    def forget(self) -> None:
        """Empty caches: the words of each known chunk by number, and by number a word's ids in one array."""
        self.known: dict[bytes, int] = {}
        self.chunks: dict[bytes, int] = {}
        self.flat, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.members, self.from_, self.many = (np.zeros(0, np.int64) for _ in range(3))

    def words(self, chunk: bytes) -> list[bytes]:
        """A chunk's special strings and words, in order."""
        text = chunk.decode()
        out: list[bytes] = []
        for part in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(part.encode())
            elif PLAIN.fullmatch(part):
                out += [w.encode() for w in self.pattern.findall(part.lower())]
            else:
                # the file's own components: their Unicode version is not that of this Python
                out += [bytes(map(self.byte.__getitem__, w)) for w, _ in self.split(self.normalise(part))]
        return out

    def words_of(self, chunks: list[bytes]) -> list[list[bytes]]:
        """The words of each of some chunks. Plain ones need no pattern; those beyond ASCII go through the file's
        components together, parted by a line end, unless there is other white space in them."""
        out: list[list[bytes]] = [[]] * len(chunks)
        wide: list[int] = []
        for k, c in enumerate(chunks):
            if c.isalpha():
                out[k] = [c.lower()]
            elif c[:-1].isalpha() and c[-1] in MARKS:
                out[k] = [c[:-1].lower(), c[-1:]]
            elif c.isascii() or any(s in c for s in self.raw_special) or len(c.decode().split()) != 1:
                out[k] = self.words(c)
            else:
                wide.append(k)
        if wide:
            text = self.normalise("\n".join([chunks[k].decode() for k in wide]))
            parts = text.split(" ")
            if len(parts) != len(wide):
                return [self.words(c) for c in chunks]
            found: list[list[bytes]] = [[] for _ in wide]
            cuts = self.split(text)
            owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), [at for _, (at, _) in cuts], "right")
            for k, (w, _) in zip(owner.tolist(), cuts, strict=True):
                found[k].append(bytes(map(self.byte.__getitem__, w)))
            for k, words in zip(wide, found, strict=True):
                out[k] = words
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 for none, or if one is no symbol."""
        code = left * self.WIDE + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.by_code[at], -1)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a word) of distinct words, all merged together through the pair occurrence index."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size + 1) - 1  # of each word: a -1, which no pair reaches over
        chain = np.full(int(ends[-1]) + 1 if len(ends) else 0, -1, np.int64)
        inside = np.ones(len(chain), bool)
        inside[ends] = False
        chain[inside] = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        chain[ends - 1] = self.final[[w[-1] for w in raw]]
        nxt, prv = np.arange(1, len(chain) + 1), np.arange(-1, len(chain) - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> bool:
            """Puts places on the lists of their pairs; whether a pair is below the rank at work."""
            live = rank >= 0
            at, rank = at[live], rank[live]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist() if len(rank) else [], np.split(at, cut), strict=False):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(active, r)
            return bool(len(rank)) and int(rank[0]) < now

        now = -1
        note(np.arange(max(0, len(chain) - 1)), self.ranks(chain[:-1], chain[1:]))
        while active:
            now = heapq.heappop(active)
            a, b = self.pair[now].tolist()
            todo = np.unique(np.concatenate(places.pop(now)))
            todo = todo[chain[todo] == a]
            todo = todo[chain[nxt[todo]] == b]
            if a == b and self.ordered and len(todo):
                # in a run of places that overlap every other one is joined, from the left
                follows = np.r_[False, nxt[todo[:-1]] == todo[1:]]
                at = np.arange(len(todo))
                todo = todo[(at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0]
            # all at once, unless a join may call for an earlier rank: then from left to right
            for part in [todo] if self.ordered else todo.reshape(-1, 1):
                part = part[(chain[part] == a) & (chain[nxt[part]] == b)]
                if not len(part):
                    continue
                gone = nxt[part]
                chain[part], chain[gone] = self.joined[now], -2
                nxt[part] = nxt[gone]
                prv[nxt[part]] = part  # a word's end always follows
                before = prv[part]
                has = before >= 0
                near = np.concatenate([part, before[has]])
                if note(near, self.ranks(chain[near], chain[nxt[near]])) and not self.ordered:
                    note(todo, np.full(len(todo), now))
                    break
        alive = chain >= 0
        total = np.cumsum(alive)[ends] if len(ends) else np.zeros(0, np.int64)
        return chain[alive], np.diff(np.r_[0, total])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in a row, and where each text's begin and end."""
        split = [t.encode().split() for t in texts]
        if len(self.chunks) > CACHE or len(self.known) > CACHE:
            self.forget()
        if fresh := sorted(set().union(*split) - self.chunks.keys()):
            inside = self.words_of(fresh)
            if new := sorted(set().union(*inside) - self.known.keys()):
                marks = [w for w in new if w.decode() in self.special]
                plain = [w for w in new if w.decode() not in self.special] if marks else new
                ids, count = self.merge(plain)
                self.known.update(zip([*plain, *marks], range(len(self.known), len(self.known) + len(new)), strict=True))
                count = np.r_[count, np.ones(len(marks), np.int64)].astype(np.int64)
                self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count].astype(np.int64)
                self.count = np.r_[self.count, count].astype(np.int64)
                self.flat = np.r_[self.flat, ids, [self.special[w.decode()] for w in marks]].astype(np.int64)
            self.chunks.update(zip(fresh, range(len(self.chunks), len(self.chunks) + len(fresh)), strict=True))
            many = np.fromiter(map(len, inside), np.int64, len(inside))
            self.from_ = np.r_[self.from_, len(self.members) + np.cumsum(many) - many].astype(np.int64)
            self.many = np.r_[self.many, many]
            self.members = np.r_[self.members, np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(inside)), np.int64, int(many.sum()))]
        chunks = np.cumsum([0, *map(len, split)])
        number = np.fromiter(map(self.chunks.__getitem__, itertools.chain.from_iterable(split)), np.int64, chunks[-1])
        word, words = gathered(self.members, self.from_[number], self.many[number])
        ids, ends = gathered(self.flat, self.first[word], self.count[word])
        return ids, ends[words[chunks]]

    def decode(self, ids: Iterable[int]) -> str:
        """As a vocabulary file without a decoder gives it: the tokens, special ones too, joined by a blank."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def encoded(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode([text])[0].tolist()


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) for every row; with ``decoded`` also the text that the ids decode to. No shuffle.

    ``path``: a word-kind tokenizers .json file, readable on every executor; truncation, padding and added
    special tokens are not used; special strings in a text become their ids. Null and empty texts have no ids
    and decode to the empty string; null ids and repeated rows stay; an empty table gives no rows; other columns
    are not read. Memory is bounded by about 2 MB of text, or one text, and the word cache.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in text_slices(batches, "t", BATCH):
            ids, offsets = bpe.encode([t or "" for t in b.column("t").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            text = [pa.array([bpe.decode(ids[a:z].tolist()) for a, z in zip(offsets, offsets[1:], strict=False)], pa.string())] * decoded
            yield pa.record_batch([b.column("i"), lists, *text], names=["doc_id", "ids", "decoded"][: 2 + decoded])
        bpe.forget()
        release()

    kept = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return kept.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for every row; null ids arrays decode to the empty string."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                s = b.slice(k, 256)
                text = [bpe.decode(x or []) for x in s.column("x").to_pylist()]
                yield pa.record_batch([s.column("i"), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("i"), F.col(ids_col).alias("x")).mapInArrow(run, "doc_id long, decoded string")
