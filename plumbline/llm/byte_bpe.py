"""Byte-level BPE by replaying merges over a corpus of words.

Instead of merging word by word, all distinct words of a block of the corpus lie in one array. An
inverted index maps each mergeable pair to the positions where it stands; merges are taken from it
in rank order, each applied at all its positions at once, and only the pairs at the touched
neighbours enter the index anew. Words don't influence each other, so blocks give the same ids as
one pass over the whole corpus, and a task holds no more than its block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.token_counts import CHUNK

#: Bounds of a worker's memory; neither changes a result.
REMEMBERED_CHUNKS = 300_000
BLOCK_BYTES = 16 << 20

_CODECS: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def sorted_set(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of several arrays, ascending."""
    values = np.sort(np.concatenate(parts))
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class MergeReplay:
    """Encodes many distinct words at once."""

    def __init__(self, tokens: list[bytes]):
        ids = {token: i for i, token in enumerate(tokens) if token}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, i in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        # The lowest rank that a merge into each token can lead to next.
        self.next_rank = np.full(len(tokens), len(tokens), np.int64)
        np.minimum.at(self.next_rank, self.keys >> 32, self.merged)
        np.minimum.at(self.next_rank, self.keys & 0xFFFFFFFF, self.merged)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into; -1 if it doesn't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        if n == 0:
            return [b""] * len(words)
        word = np.repeat(np.arange(len(words)), sizes)
        token = np.append(self.byte_ids[text], -1)
        # Neighbours inside a word; n stands for none.
        after = np.arange(1, n + 2)
        after[:-1][np.append(word[1:] != word[:-1], True)] = n
        before = np.arange(-1, n)
        before[:-1][np.append(True, word[1:] != word[:-1])] = n
        alive = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            at = at[after[at] < n]
            rank = self.ranks(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, part in zip(rank[starts].tolist(), np.split(at, starts[1:]), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        enter(np.flatnonzero(after[:-1] < n))
        while heap:
            r = heapq.heappop(heap)
            at = sorted_set(index.pop(r))
            at = at[alive[at] & (after[at] < n)]
            at = at[self.ranks(token[at], token[after[at]]) == r]
            if not len(at):
                continue
            # Where occurrences overlap, the left one goes first: every other one of a chain.
            chained = np.append(False, after[at[:-1]] == at[1:])
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(chained, 0, place))
            now = (place - head) % 2 == 0
            if self.next_rank[r] < r:
                # This merge may make a pair of lower rank, which is due before r's next position.
                now &= np.append(True, word[at[1:]] != word[at[:-1]])
                if not now.all():
                    index[r] = [at[~now]]
                    heapq.heappush(heap, r)
            at = at[now]
            gone = after[at]
            token[at] = r
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            previous = before[at]
            enter(sorted_set([at, previous[previous < n]]))
        kept = np.flatnonzero(alive[:-1])
        ids = token[kept].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[kept], minlength=len(words))).tolist()
        return [ids[4 * a : 4 * b] for a, b in itertools.pairwise([0, *ends])]


class Codec:
    """Encodes and decodes texts with a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.replay = MergeReplay(self.tokens)
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """The worker's own codec, kept between tasks."""
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = cls(path, pattern)
        return _CODECS[path, pattern]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, every distinct chunk of the block encoded once."""
        chunked = [CHUNK.findall(text) for text in texts]
        fresh = [c for c in set().union(*chunked) if c not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED_CHUNKS:
            self.known = {}
            fresh = list(set().union(*chunked))
        split = [self.split.findall(chunk) for chunk in fresh]
        words = list(set(itertools.chain.from_iterable(split)))
        ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
        known = self.known
        for chunk, parts in zip(fresh, split, strict=True):
            known[chunk] = b"".join(map(ids.__getitem__, parts))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in chunked]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def blocks(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` characters, a longer text alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if texts:
        yield start, len(texts)


def encode_decode(
    df: DataFrame,
    *,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Encode every text and decode its ids.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) and, with ``with_ids``, ids (array) and
    decoded (binary). ``vocabulary`` is a rank file that workers can open, ``pattern`` splits a
    text; each match is encoded by itself, special tokens don't exist.

    A null text counts as empty: 0 tokens, digests of nothing. Null and repeated ids, ties and
    repeated rows are encoded like any other row; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<long>, decoded binary" if with_ids else ""
    )
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in blocks(texts, BLOCK_BYTES):
                ids = codec.encode_block(texts[start:stop])
                decoded = [codec.decode(x) for x in ids]
                columns = {
                    "id": batch.column("id").slice(start, stop - start),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))
                    columns["decoded"] = pa.array(decoded, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, {out}").withColumnRenamed("id", id_col)
