"""Best-fit packing of token pieces into sequences of a fixed length, improved by local search.

Documents are tokenized and cut into pieces; only the pieces' lengths travel further. Pieces are
dealt evenly into shards. A shard is packed best-fit, longest first, and then improved by
exchanges between a poorly filled bin and others, each of which increases the sum of squared fills,
until bins run empty. What lies in bins that stay loose is packed once more across shards.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.memory import release
from plumbline.session import cut_lineage

#: Words whose ids a worker remembers, and bytes of text it encodes at once. They bound memory and
#: change no result.
REMEMBERED_WORDS = 300_000
BLOCK_BYTES = 8 << 20
#: Pieces packed together; a shard is small enough for one task and large enough to pack well.
SHARD_PIECES = 4096

#: Words whose normal form is their lower case, with ASCII marks after them: both parts are
#: encoded by themselves in such a chunk, so they can be remembered apart.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
PLAIN_PART = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:-;=?-@\\[-`}~]+")

_ENCODERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes blocks of texts with the tokenizers library, each distinct word of a block once.

    For vocabularies that drop white space and give a word the same ids wherever it stands.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.spell = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> ChunkEncoder:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def learned(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > REMEMBERED_WORDS:
            known.clear()
            fresh = words
        tokenize = self.model.tokenize
        for word in fresh:
            if not word:
                ids = []
            elif not PLAIN_PART.fullmatch(word):
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            else:
                # Such a part is one word to the model and its own normal form: only its bytes need to be
                # spelled in the model's alphabet, where ASCII marks and letters are themselves.
                spelled = word if word.isascii() else self.spell.pre_tokenize_str(word)[0][0]
                ids = [t.id for t in tokenize(spelled)]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return [known[w] for w in words]

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start, and the last one's end."""
        # The kernel splits at ASCII white space alone; what it leaves empty has no ids.
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary
        plain = pc.extract_regex(distinct, PLAIN)
        odd = pc.is_null(plain)
        first = pc.if_else(odd, distinct, pc.utf8_lower(plain.field("word"))).dictionary_encode()
        second = pc.if_else(odd, "", plain.field("marks")).dictionary_encode()
        parts = self.learned(first.dictionary.to_pylist()) + self.learned(second.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        pair = np.column_stack([first.indices.to_numpy(), second.indices.to_numpy() + len(first.dictionary)])
        taken = pair[chunks.indices.to_numpy()].ravel()
        n = sizes[taken]
        ends = np.cumsum(n)
        found = ids[np.repeat(starts[taken] - (ends - n), n) + np.arange(n.sum())]
        ends = np.append(0, ends[1::2])
        return found, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def encode(self, text: str) -> bytes:
        """One text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_block(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def blocks(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with texts of about ``most`` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def token_pieces(
    df: DataFrame, *, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and the end id, cut at ``capacity``."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(vocabulary)
        for batch in batches:
            for block in blocks(batch):
                rows: tuple[list, ...] = ([], [], [], [], [])
                found, starts = encoder.encode_block(block.column("text"))
                for i, (start, stop) in enumerate(pairwise(starts.tolist())):
                    ids = np.append(found[start:stop], end)
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        for column, x in zip(rows, (i, piece, at, len(part), zlib.crc32(part)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                    + [pa.array(x, pa.int64()) for x in rows[2:]],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
        release()

    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(work, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r exists
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(item)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def choices(items: list[int], lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The items and pairs of items of a bin by total length, one for each length or pair of lengths."""
    by_length: dict[int, list[int]] = {}
    for i in items:
        by_length.setdefault(lengths[i], []).append(i)
    singles = list(by_length.items())
    found = [(n, (same[0],)) for n, same in singles]
    found += [(n + m, (same[0], other[0])) for k, (n, same) in enumerate(singles) for m, other in singles[:k]]
    found += [(2 * n, (same[0], same[1])) for n, same in singles if len(same) > 1]
    found.sort()
    return found


def exchange(offers: list, sizes: list[int], back: list, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What goes to another bin and what comes back, to fill at most ``room`` more of it.

    ``offers`` and ``back`` are the choices of the two bins, ``sizes`` the lengths of the offers. A
    step is a move, one for one, two for one or one for two; the best one fills most.
    """
    best, found = 0, None
    for n, items in (NOTHING, *back):
        at = bisect_right(sizes, n + room) - 1
        while at >= 0 and sizes[at] - n > best and len(items) == 2 and len(offers[at][1]) == 2:
            at -= 1  # two for two is no step of this search
        if at >= 0 and sizes[at] - n > best and (items or len(offers[at][1]) == 1):
            best, found = sizes[at] - n, (offers[at][1], items)
            if best == room:
                break
    return found


#: What comes back when a document moves.
NOTHING: tuple[int, tuple[int, ...]] = (0, ())


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by exchanges that increase the sum of squared fills.

    Takes the emptiest bin that may still improve and exchanges with fuller ones. Ends at the lower
    bound, or when no exchange between any two bins improves: a bin is compared again only with
    bins that have changed since it was compared last.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    fewest = -(-sum(fill) // capacity)
    left = len(bins)
    known: list[tuple[list, list[int]] | None] = [None] * len(bins)
    changed, compared, now = [0] * len(bins), [-1] * len(bins), 0

    def of(b: int) -> tuple[list, list[int]]:
        if known[b] is None:
            found = choices(bins[b], lengths)
            known[b] = found, [n for n, _ in found]
        return known[b]

    waiting = [(f, b) for b, f in enumerate(fill)]
    heapify(waiting)
    latest = 0  # when any bin changed last
    while left > fewest and waiting:
        f, d = heappop(waiting)
        if f != fill[d] or not bins[d] or compared[d] >= latest:
            continue
        improved = True
        while improved and bins[d]:
            improved = False
            since = -1 if changed[d] > compared[d] else compared[d]
            compared[d] = now
            partners = [b for b in range(len(bins)) if b != d and fill[d] <= fill[b] < capacity and changed[b] > since]
            for b in sorted(partners, key=lambda b: -fill[b]):
                found = exchange(*of(d), of(b)[0], capacity - fill[b])
                if found is None:
                    continue
                there, back = found
                gain = sum(lengths[i] for i in there) - sum(lengths[i] for i in back)
                bins[d] = [i for i in bins[d] if i not in there] + list(back)
                bins[b] = [i for i in bins[b] if i not in back] + list(there)
                fill[d] -= gain
                fill[b] += gain
                known[d] = known[b] = None
                now += 1
                changed[d] = changed[b] = latest = now
                improved = True
                heappush(waiting, (fill[b], b))
                if not bins[d]:
                    break
        if not bins[d]:
            left -= 1
        else:
            heappush(waiting, (fill[d], d))
        if not waiting or compared[waiting[0][1]] >= latest:
            # Whatever else changed meanwhile may let others improve.
            waiting = [(fill[b], b) for b in range(len(bins)) if bins[b] and compared[b] < latest]
            heapify(waiting)
    return [b for b in bins if b]


def pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds bin, offset and the bin's fill to a shard's pieces."""
    lengths = frame["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for b, items in enumerate(bins):
        sizes = np.array([lengths[i] for i in items], np.int64)
        where[items], offset[items], filled[items] = b, np.cumsum(sizes) - sizes, sizes.sum()
    return frame.assign(bin=where, offset=offset, fill=filled)


def pack(
    pieces: DataFrame, *, capacity: int, shard_pieces: int = SHARD_PIECES, loose: float = 0.99
) -> DataFrame:
    """Add sequence_id and offset to rows with a column ``length`` between 1 and ``capacity``.

    Runs eagerly: rows are checkpointed with the random number that deals them out, so that they keep
    their shard if a task runs again and shards are even however the rows lie. Columns
    other than ``length`` are carried along; shard, bin, fill, sequence_id and offset are replaced.
    """
    pieces = pieces.drop("shard", "bin", "fill", "sequence_id", "offset")

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        rows = cut_lineage(rows.withColumn("shard", F.rand(turn)))
        shards = max(1, -(-rows.count() // shard_pieces))
        rows = rows.withColumn("shard", F.floor(F.col("shard") * shards))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        done = rows.groupBy("shard").applyInPandas(
            lambda frame: pack_shard(frame, capacity), f"{fields}, bin long, offset long, fill long"
        )
        number = F.shiftleft(F.col("shard") * 2 + turn, 32) + F.col("bin")
        return done.withColumn("sequence_id", number).drop("shard", "bin")

    first = cut_lineage(packed(pieces, 0))
    tight = F.col("fill") >= int(loose * capacity)
    again = packed(first.where(~tight).drop("fill", "sequence_id", "offset"), 1)
    return first.where(tight).unionByName(again).drop("fill")


def pack_documents(
    df: DataFrame,
    *,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset). Only a
    document longer than a sequence is cut. A null or empty text is its end id alone; null and
    repeated ids and repeated rows are packed like any other; equal lengths may be placed either
    way; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    pieces = token_pieces(
        df, vocabulary=vocabulary, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col
    )
    return pack(pieces, capacity=capacity, shard_pieces=shard_pieces).withColumnRenamed("id", id_col)
