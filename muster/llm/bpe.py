"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are leaves of some tens of characters; leaves are encoded, and neighbours are joined up
the tree.  A join re-encodes a window around the seam that grows until the tokens outside provably stay as they are:

* Between matches of the tokenizer's pattern the window grows until it begins and ends where a new match begins whatever else
  the text holds: before a space or line feed that follows a character that is no white space, as no match goes on from such
  a character into white space.
* A match longer than a leaf is halved itself, at any byte, and its leaves are merged by the ranks.  The window grows by tokens, twice
  as many each time, until its first and last token fit their neighbours outside: two tokens fit if their bytes together are
  encoded as these two.  A sequence of tokens that all fit their neighbours is the encoding of its bytes: merges that
  would go over the border of two tokens would go over it in these two alone, as all that a token's bytes go through before
  the token is whole happens inside of it, at lower ranks.  So tokens outside of such a window cannot change.

A text without a place of the first kind is cut into its matches at once, and these are halved.  The result is that of
encoding the text at once.  Decoding concatenates the bytes of the tokens up the same kind of tree.

The library merges matches of up to a leaf, and a worker remembers their tokens.

Defined results: a null text counts as empty and gives no tokens; bytes that aren't UTF-8 count as U+FFFD; texts of any length
are taken whole; repeated rows give repeated rows; an empty table gives none; columns but the two named are not looked at,
whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, map_texts, table

#: Characters of a leaf, tokens of a leaf when decoding.
LEAF, LEAF_TOKENS = 96, 96
#: Characters to either side of a seam with which a window begins to grow.
WINDOW = 16
#: A place where a new match of PATTERN of public_tokenizers begins in any text.
STABLE = r"(?<=\S)[ \n]"
#: Short matches whose tokens a worker remembers.
REMEMBERED = 1 << 17


class Tokenizer:
    """``stable`` must find only places where the pattern begins a new match in any text; each pattern needs its own."""

    def __init__(self, ranks_path: str, pattern: str, stable: str | None = None) -> None:
        if stable is None:
            import public_tokenizers

            if pattern != public_tokenizers.PATTERN:
                raise ValueError("give the stable places of a pattern of your own")
            stable = STABLE
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.stable = regex.compile(pattern), regex.compile(stable)
        self.merger = tiktoken.Encoding("one match", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.ranks, self.known, self.fits = ranks, {}, {}

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """The library for whole texts; it holds a vocabulary of its own."""
        return tiktoken.Encoding("whole texts", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.part(text, 0, len(text))

    def part(self, text: str, lo: int, hi: int) -> list[int]:
        """The tokens that text[lo:hi] has on its own."""
        if hi - lo <= LEAF or not self.stable.search(text, lo + 1, hi):
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.part(text, lo, mid), self.part(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        """The tokens of text[lo:hi] from the tokens a of text[lo:mid] and b of text[mid:hi]; a is used up."""
        start, stop = self.grown(text, lo, mid, hi)
        if stop > mid:  # else the seam itself is stable
            over = len(text[start:mid].encode())
            while over > 0:
                over -= len(self.bytes_of[a.pop()])
            skip, over = 0, len(text[mid:stop].encode())
            while over > 0:
                over -= len(self.bytes_of[b[skip]])
                skip += 1
            a += self.leaf(text[start:stop])
            if skip:
                del b[:skip]
        a += b
        return a

    def grown(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The window around mid that has grown to stable places, or to the part's ends."""
        size, start, stop = WINDOW, None, None
        while start is None or stop is None:
            if stop is None:
                m = self.stable.search(text, mid, min(hi, mid + size))
                stop = m.start() if m else hi if mid + size >= hi else None
                if stop == mid:
                    return mid, mid
            if start is None:
                found = [m.start() for m in self.stable.finditer(text, max(lo, mid - size), mid)]
                start = found[-1] if found else lo if mid - size <= lo else None
            size *= 2
        return start, stop

    def leaf(self, text: str) -> list[int]:
        """Each match of the pattern by the ranks."""
        out, known = [], self.known
        for match in self.pattern.findall(text):
            ids = known.get(match)
            if ids is None:
                if len(match) > LEAF:
                    ids = self.halved(match.encode())
                else:
                    ids = self.merger.encode_ordinary(match)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[match] = ids
            out += ids
        return out

    def halved(self, match: bytes) -> list[int]:
        """The tokens of a match's bytes, by a tree of its own."""
        if len(match) <= LEAF:
            return self.merged(match)
        mid = len(match) // 2
        return self.joined(self.halved(match[:mid]), self.halved(match[mid:]))

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of the bytes of a and b together."""
        if self.fit(a[-1], b[0]):
            return a + b
        k = 1
        while True:
            lo, hi = max(0, len(a) - k), min(len(b), k)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, a[lo:] + b[:hi])))
            if (not lo or self.fit(a[lo - 1], window[0])) and (hi == len(b) or self.fit(window[-1], b[hi])):
                return a[:lo] + window + b[hi:]
            k *= 2

    def fit(self, x: int, y: int) -> bool:
        """Whether the bytes of the two tokens are encoded as these two."""
        known = self.fits.get((x, y))
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[x, y] = self.merged(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return known

    def merged(self, data: bytes) -> list[int]:
        """Bytes merged by the ranks: again and again the neighbours whose bytes together have the lowest rank, the first of equals."""
        ranks, ends = self.ranks, [*range(1, len(data) + 1)]  # where the part that begins at each byte ends
        begins = [*range(-1, len(data) - 1)]  # where the part before it begins
        heap = [(r, k, k + 2) for k in range(len(data) - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            middle = ends[k]
            if middle == 0 or middle >= len(data) or ends[middle] != end:  # one of the two is no more
                continue
            ends[k], ends[middle] = end, 0
            if end < len(data):
                begins[end] = k
                if (r := ranks.get(data[k : ends[end]])) is not None:
                    heapq.heappush(heap, (r, k, ends[end]))
            if (before := begins[k]) >= 0 and (r := ranks.get(data[before:end])) is not None:
                heapq.heappush(heap, (r, before, end))
        return [ranks[data[k : ends[k]]] for k in range(len(data)) if ends[k]]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tokenizer(ranks_path: str, pattern: str, stable: str | None = None) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(ranks_path, pattern, stable)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", stable: str | None = None) -> DataFrame:
    """id, ids (the tokens of the text) and decoded (the bytes that they stand for) of every row."""
    tokenizer(ranks_path, pattern, stable)  # mistakes show here, not in a task

    def run(keys: list, texts: list) -> dict:
        t = tokenizer(ranks_path, pattern, stable)
        parts, decoded = [np.zeros(0, np.int32)], []
        for x in texts:
            ids = t.encode(x.decode(errors="replace"))
            decoded.append(t.decode(ids))
            parts.append(np.array(ids, np.int32))  # 4 bytes a token instead of a Python number
        flat, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts], dtype=np.int32)
        return {"id": keys, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": decoded}

    return map_texts(docs, run, f"id {kind(docs, id_col)}, ids array<int>, decoded binary", text_col, id_col)


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids joined by spaces and of the decoded bytes."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    got = round_trip(docs, ranks_path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
