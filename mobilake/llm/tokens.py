"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer.

Every distinct pre-token of a task is encoded once: a priority queue holds the
merge ranks of adjacent symbols, the symbols form a doubly linked list, and
queue entries that a merge has made stale are skipped when they come up. So a
pre-token of n bytes takes O(n log n), however long it is. Texts are cut into
pre-tokens by the tokenizer's own pattern and looked up in the cache.

Defined cases: null and empty text both give an empty list; special tokens in
a text are ordinary text; texts are never cut; every id list decodes to the
text's UTF-8 bytes. Lone surrogates cannot reach the operator (Spark strings
are UTF-8).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts text into pre-tokens for this vocabulary. Letters and
# digits stand first, which changes no match (they share no first character with the
# contractions) and saves most of the attempts.
PATTERN = r" ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000


class BytePairs:
    """Ranks by bytes; encode and decode."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.pieces = {r: b for b, r in ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = _Cache(self)

    @classmethod
    def parse(cls, data: bytes) -> BytePairs:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i]
            if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
                continue  # stale: one of the two has been merged since
            part[i] += part[j]
            part[j] = None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(queue, (r, i, len(part[i]) + len(part[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(queue, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p is not None]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Cache(dict):
    """Pre-token -> ids; emptied when it has grown to its bound."""

    def __init__(self, owner: BytePairs):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.owner.merge(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 200:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _loaded(data: bytes) -> BytePairs:
    return BytePairs.parse(data)


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BytePairs:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return BytePairs.parse(f.read())


def _shared(spark: SparkSession, name: str, folder: str) -> Callable[[], BytePairs]:
    """The vocabulary file (under 2 MB, fixed by its publisher) is read on the driver and broadcast."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    return lambda: _loaded(data.value)


def _lists(text: pa.Array, bp: BytePairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the ends of each text's ids."""
    find, get = bp.find, bp.cache.__getitem__
    ends, parts, n = [0], [], 0
    for t in text:
        s = t.as_py()
        if s:
            ids = np.fromiter(chain.from_iterable(map(get, find(s))), np.int32)
            n += len(ids)
            parts.append(ids)
        ends.append(n)
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.asarray(ends, np.int64)


def encoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[Column], Column]:
    """A Column function: text -> array<int> of token ids."""
    vocab = _shared(spark, name, folder)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        ids, ends = _lists(text, vocab())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    return encode


def decoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[Column], Column]:
    """A Column function: token ids -> text; null ids give an empty text."""
    vocab = _shared(spark, name, folder)

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        bp = vocab()
        return pa.array([bp.decode(x or []).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return decode


def counter(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[Column], Column]:
    """A Column function: text -> bigint number of tokens; no ids leave the worker."""
    vocab = _shared(spark, name, folder)

    @F.arrow_udf(T.LongType())
    def count(text: pa.Array) -> pa.Array:
        bp = vocab()
        find, size = bp.find, bp.cache.__getitem__
        return pa.array([sum(map(len, map(size, find(s)))) if (s := t.as_py()) else 0 for t in text], pa.int64())

    return count
