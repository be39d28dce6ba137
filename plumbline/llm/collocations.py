"""Collocations by sampling and a negative border (Toivonen's mining of frequent phrases).

A sample of the documents proposes phrases at a lowered support, level by level. A full pass then counts,
exactly, every word and every phrase whose two shorter ends (all but its last word, all but its first)
were proposed: these are the proposed phrases and their negative border. A phrase of the border that
turns out frequent is a failure of the sample. If there are any, an expansion pass counts every phrase
that is still open, that is one whose ends are each frequent or themselves open; after it no frequent
phrase can be left uncounted.

What was proposed and what is frequent travels as bit tables of fixed size. A phrase that hits set bits
by chance is counted in vain, and one that was entered is never missed, so the tables' size bounds memory
and changes no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.memory import release
from plumbline.session import cut_lineage

#: Words that a task counts at once, distinct words it remembers, and phrases it adds up at once. They
#: bound memory and change no count.
CHUNK_WORDS = 1_500_000
REMEMBERED_WORDS = 300_000
HELD_PHRASES = 1_000_000
#: Bits of the table of proposed phrases (a power of two), and bits set for each phrase.
TABLE_BITS = 1 << 27
PROBES = 2
#: First bytes of a key that a block leaves out if the key before has them too; at most 255.
SHARED_BYTES = 8

#: The end of a piece. No UTF-8 text holds this byte.
CUT = b"\xff"
#: Marks and line ends that cut, a tabulator that separates like a blank, and A-Z lower-cased.
WORD_BYTES = bytes(
    255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
MIXERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def words_and_cuts(text: str) -> list[bytes]:
    """The words of a text, with ``CUT`` between pieces and at the end."""
    # What bytes.split() takes for white space beyond blanks has become a cut.
    found = text.encode().translate(WORD_BYTES).replace(CUT, b" \xff ").split()
    found.append(CUT)
    return found


class Words(dict):
    """Numbers words as they come, the cut first."""

    def __init__(self):
        super().__init__()
        self.listed: list[bytes] = []
        self.hashes = np.empty(1 << 16, np.uint64)
        self.done = 0
        self[CUT]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.listed)
        self.listed.append(word)
        return n

    def hashed(self) -> np.ndarray:
        """Each word's 64-bit hash, by number."""
        done, n = self.done, len(self.listed)
        if n > len(self.hashes):
            self.hashes = np.append(self.hashes[:done], np.empty(2 * n - done, np.uint64))
        if n > done:
            digest = xxhash.xxh64_intdigest
            self.hashes[done:n] = np.fromiter(map(digest, self.listed[done:]), np.uint64, n - done)
            self.done = n
        return self.hashes[:n]


def at_cuts(ids: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text's word numbers in parts of about ``most``; no piece is taken apart."""
    start = 0
    while len(ids) - start > most:
        cuts = np.flatnonzero(ids[start : start + most] == 0)
        stop = start + 1 + int(cuts[-1] if len(cuts) else np.flatnonzero(ids[start:] == 0)[0])
        yield ids[start:stop]
        start = stop
    if start < len(ids):
        yield ids[start:]


def language_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word. Products wrap around."""
    mixed = prefix * MIXERS[0] + word
    return mixed ^ (mixed >> np.uint64(29))


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the table that stand for each hash."""
    shift = np.uint64(64 - (bits - 1).bit_length())
    return [((hashes ^ (hashes >> np.uint64(31))) * m >> shift).astype(np.int64) for m in MIXERS[:PROBES]]


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table has all bits of each hash."""
    found = np.ones(len(hashes), bool)
    for at in places(hashes, 8 * len(table)):
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def count_chunk(
    ids: np.ndarray,
    hashes: np.ndarray,
    seed: np.uint64,
    longest: int,
    proposed: np.ndarray,
    frequent: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, the distinct phrases (as rows of word numbers), their hashes and occurrences.

    The last number is the cut. In a first pass these are the words and what has both ends in the table
    ``proposed``. In an expansion pass, ``frequent`` has what the first pass found frequent, and these
    are the phrases that the first pass didn't reach and whose ends are frequent or weren't reached.
    """
    cut = len(hashes) - 1
    # Of each distinct phrase of the current length: its words, hash, whether the first pass reaches it.
    phrases = np.arange(len(hashes))[:, None]
    value = extended(np.full(len(hashes), seed), hashes)
    reached = np.ones(len(hashes), bool)
    if frequent is None:
        counts = np.bincount(ids, minlength=len(hashes))[:cut]
        there = np.flatnonzero(counts)
        yield phrases[there], value[there], counts[there]
    # The phrase that starts at each of the places that still count.
    at, number = np.arange(len(ids), dtype=np.int32), ids
    for length in range(1, longest):
        extends = reached & holds(proposed, value)
        good = extends if frequent is None else ~reached | holds(frequent, value)
        if length == 1:
            good[cut] = False
        usable = good[number]
        at, number = at[usable], number[usable]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        keys = number[follows].astype(np.int64) * max(len(phrases), 1) + number[follows + 1]
        at = at[follows]
        keys, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        number = number.astype(np.int32)
        left, right = np.divmod(keys, max(len(phrases), 1))
        last = phrases[right, -1]
        reached = extends[left] & extends[right]
        phrases, value = np.column_stack([phrases[left], last]), extended(value[left], hashes[last])
        fresh = slice(None) if frequent is None else ~reached
        yield phrases[fresh], value[fresh], counts[fresh]


def spelled(phrases: np.ndarray, words: pa.Array) -> pa.Array:
    """Rows of word numbers as space-joined strings."""
    columns = [words.take(pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")


def packed(column: np.ndarray) -> bytes:
    """Numbers from 0 on in their narrowest type, compressed by themselves: unlike columns mix badly."""
    narrow = column.astype(np.min_scalar_type(int(column.max(initial=0))), copy=False)
    block = pa.compress(narrow.tobytes(), codec="zstd", asbytes=True)
    return np.array([narrow.itemsize, narrow.nbytes, len(block)], "<u4").tobytes() + block


def unpacked(block: bytes) -> Iterator[np.ndarray]:
    """The columns of one ``packed`` after another."""
    at = 0
    while at < len(block):
        width, size, taken = np.frombuffer(block, "<u4", 3, at).tolist()
        at += 12
        whole = pa.decompress(block[at : at + taken], decompressed_size=size, codec="zstd", asbytes=True)
        yield np.frombuffer(whole, f"<u{width}")
        at += taken


def own_bytes(offsets: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which bytes of the keys between ``offsets`` come after the first ``shared`` of their key."""
    return np.repeat(offsets[:-1] + shared, np.diff(offsets)) <= np.arange(offsets[-1], dtype=np.int32)


def block_of(keys: pa.Array, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, compressed. The first bytes that a key shares with the one before
    (``SHARED_BYTES`` at most) are left out."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    text = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    padded = np.append(text, np.zeros(SHARED_BYTES, np.uint8))
    heads = np.lib.stride_tricks.sliding_window_view(padded, SHARED_BYTES)[offsets[:-1]]
    same = heads[1:] == heads[:-1]
    equal = np.where(same.all(axis=1), SHARED_BYTES, same.argmin(axis=1))
    shared = np.zeros(len(keys), np.int32)
    shared[1:] = np.minimum(equal, np.minimum(lengths[1:], lengths[:-1]))
    rest = text[own_bytes(offsets, shared)]
    return b"".join(map(packed, (shared, lengths - shared, counts, rest)))


def table_of(block: bytes) -> pa.Table:
    """The keys and counts of a block."""
    shared, rests, counts, rest = unpacked(block)
    shared = shared.astype(np.int32)
    offsets = np.append(np.int32(0), np.cumsum(shared + rests, dtype=np.int32))
    text = np.empty(offsets[-1], np.uint8)
    text[own_bytes(offsets, shared)] = rest
    # A shared byte is that of the last key before which didn't share it.
    place, starts = np.arange(SHARED_BYTES, dtype=np.int32)[:, None], offsets[:-1]
    left_out = place < shared
    owner = np.maximum.accumulate(np.where(left_out, 0, np.arange(len(shared), dtype=np.int32)), axis=1)
    text[(starts + place)[left_out]] = text[(starts[owner] + place)[left_out]]
    keys = pa.Array.from_buffers(pa.string(), len(shared), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    return pa.table({"key": keys, "f": counts.astype(np.int64)})


def counted(
    texts: DataFrame, *, longest: int, least: int, proposed, frequent=None, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """(lang, phrase, size, f): the phrases of ``count_chunk`` with at least ``least`` occurrences.

    ``proposed`` and ``frequent`` are broadcast bit tables. In a first pass the phrase '' has the number
    of all words. A task counts chunk by chunk and deals the phrases out by their hashes, each share as
    one compressed block; what rows of the shuffle would hold of a phrase is several times as much.
    """
    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunk(held: dict[str, list[np.ndarray]], words: Words) -> Iterator[pa.RecordBatch]:
        # Words are numbered anew in their order, so that phrases come out sorted; the cut is the last one.
        listed = pa.array(words.listed, pa.binary())
        order = pc.sort_indices(listed).to_numpy()
        renumbered = np.empty(len(order), np.int32)
        renumbered[order] = np.arange(len(order), dtype=np.int32)
        hashes, spelling = words.hashed()[order], listed.take(pa.array(order[:-1])).cast(pa.string())
        keys, counts, shares = [], [], []
        tables = [None if t is None else np.frombuffer(t.value, np.uint8) for t in (proposed, frequent)]
        for lang in sorted(held):
            ids = renumbered[np.concatenate(held[lang])]
            if frequent is None:
                keys.append(pa.array([f"{lang}\n"]))
                counts.append(np.array([np.count_nonzero(ids != len(order) - 1)]))
                shares.append(np.zeros(1, np.int64))
            for phrases, values, n in count_chunk(ids, hashes, language_seed(lang), longest, *tables):
                keys.append(pc.binary_join_element_wise(pa.scalar(lang), spelled(phrases, spelling), "\n"))
                counts.append(n)
                shares.append(((values ^ values >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))
        share = np.concatenate(shares)
        by_share = np.argsort(share, kind="stable")
        ends = np.searchsorted(share[by_share], np.arange(buckets + 1))
        every, n = pa.concat_arrays(keys).take(pa.array(by_share)), np.concatenate(counts)[by_share]
        some = np.flatnonzero(np.diff(ends))
        for at in range(0, len(some), 256):
            part = some[at : at + 256].tolist()
            blocks = [block_of(every.slice(ends[b], ends[b + 1] - ends[b]), n[ends[b] : ends[b + 1]]) for b in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = words_and_cuts(text.as_py())
                ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                for part in at_cuts(ids, chunk_words):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= chunk_words:
                        yield from chunk(held, words)
                        held, size = {}, 0
                if len(words) > REMEMBERED_WORDS:
                    if held:
                        yield from chunk(held, words)
                    words, held, size = Words(), {}, 0
        if held:
            yield from chunk(held, words)
        release()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        bucket = None

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("key").aggregate([("f", "sum")]).rename_columns(["key", "f"])

        def finished() -> Iterator[pa.RecordBatch]:
            whole = summed()
            total = pc.ends_with(whole.column("key"), "\n")
            whole = whole.filter(pc.or_(pc.greater_equal(whole.column("f"), least), total)).combine_chunks()
            for batch in whole.to_batches(max_chunksize=100_000):
                halves = pc.split_pattern(batch.column("key"), "\n", max_splits=1, reverse=True)
                lang, phrase = pc.list_element(halves, 0), pc.list_element(halves, 1)
                n = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1))
                yield pa.RecordBatch.from_arrays(
                    [lang, phrase, n.cast(pa.int32()), batch.column("f")], ["lang", "phrase", "size", "f"]
                )

        for batch in batches:
            for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if b != bucket and held:
                    yield from finished()
                    held.clear()
                bucket = b
                held.append(table_of(block.as_py()))
                if sum(map(len, held)) > 2 * len(held[0]) + HELD_PHRASES:
                    held[:] = [summed()]
        if held:
            yield from finished()
        release()

    blocks = texts.select("lang", "text").mapInArrow(count, "bucket int, block binary")
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add_up, "lang string, phrase string, size int, f long")


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hash of each phrase, as ``count_chunk`` extends it word by word."""
    split = [p.encode().split(b" ") for p in phrases]
    value = np.array([language_seed(lang) for lang in langs], np.uint64)
    for i in range(max(map(len, split), default=0)):
        rows = np.array([r for r, s in enumerate(split) if len(s) > i], np.int64)
        word = np.array([xxhash.xxh64_intdigest(split[r][i]) for r in rows], np.uint64)
        value[rows] = extended(value[rows], word)
    return value


def bit_table(phrases: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits with those of all (lang, phrase); the driver gets its words that aren't zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            for at in places(hashes, bits):
                np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        words = table.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    found = phrases.select("lang", "phrase").mapInArrow(work, "at long, word long")
    # Words of the table, each once: at most the table itself, and less when it is compressed.
    merged = found.groupBy("at").agg(F.bit_or("word").alias("word"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, word = batch.column("at").to_numpy(), batch.column("word").to_numpy()
            order = np.argsort(at)
            both = np.diff(at[order], prepend=0).astype("<i4").tobytes() + word[order].astype("<i8").tobytes()
            block = pa.compress(both, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(order)], pa.int64()), pa.array([block], pa.binary())], ["n", "block"]
            )

    table = np.zeros(bits // 64, np.int64)
    for row in merged.mapInArrow(packed, "n long, block binary").collect():
        both = pa.decompress(bytes(row.block), decompressed_size=12 * row.n, codec="zstd", asbytes=True)
        table[np.cumsum(np.frombuffer(both, "<i4", row.n))] = np.frombuffer(both, "<i8", row.n, 4 * row.n)
    return table.view(np.uint8)


def outside(phrases: DataFrame, table) -> DataFrame:
    """Those of (lang, phrase, size, f) that the broadcast table doesn't hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            hashes = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            yield batch.filter(pa.array(~holds(bits, hashes)))

    return phrases.mapInArrow(work, phrases.schema)


def frequent_phrases(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    longest: int = 4,
    sample_of: int = 8,
    lowered: float = 0.8,
    table_bits: int = TABLE_BITS,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(lang, phrase, size, f): every phrase of 1 to ``longest`` words that occurs ``least`` times, and, as
    the phrase '' of size 0, the number of all words of each language.

    One in ``sample_of`` rows, chosen by a hash of id and text, is the sample; a phrase is proposed from
    ``lowered`` times the occurrences that ``least`` lets expect there, twice at least. Both change what
    is counted in vain and whether an expansion pass is needed, never the result. Runs eagerly: each full
    pass's frequent phrases are checkpointed.
    """
    share = df.sparkSession.sparkContext.broadcast
    texts = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(id_col).alias("id"),
    )
    sample = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(sample_of)) == 0)
    support = max(2, int(lowered * least / sample_of))
    table = np.zeros(table_bits // 8, np.uint8)
    for size in range(1, longest):
        found = counted(
            sample, longest=size, least=support, proposed=share(table.tobytes()), chunk_words=chunk_words
        )
        table = table | bit_table(found.where(F.col("size") == size), table_bits)
    proposed = share(table.tobytes())
    first = cut_lineage(
        counted(texts, longest=longest, least=least, proposed=proposed, chunk_words=chunk_words)
    )
    extending = first.where(F.col("size").between(1, longest - 1))
    if outside(extending, proposed).isEmpty():
        return first
    frequent = share(bit_table(extending, table_bits).tobytes())
    more = counted(
        texts, longest=longest, least=least, proposed=proposed, frequent=frequent, chunk_words=chunk_words
    )
    return first.unionByName(cut_lineage(more))


def collocations(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    longest: int = 4,
    covered: int = 80,
    top: int = 2000,
    **mining,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's strongest phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts at its weakest cut, ``n`` all words of the
    language. A phrase with ``covered`` percent of its occurrences inside one longer phrase is left out.

    Null texts count as empty and null languages as ``und``; repeated rows count again; ties fall to
    fewer words before the cut and, in the ranks, to the phrase that sorts first. Pieces and words are
    those of whole texts, however long. An empty table gives no rows; other columns are ignored.
    Further keywords go to ``frequent_phrases``.
    """
    spark = df.sparkSession
    counts = frequent_phrases(
        df, id_col=id_col, text_col=text_col, lang_col=lang_col, least=least, longest=longest, **mining
    )
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(f"size BETWEEN 1 AND {longest - 1}").select("lang", F.col("phrase").alias("part"), "f")
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))

    # A candidate once for each cut, with the counts of both sides.
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("right"),
    )
    lefts = parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    rights = parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .withColumn("score", F.expr("(CAST(a AS decimal(20,0)) * 2000000bd) div (CAST(l AS decimal(20,0)) + r)"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )

    # The largest count among the longer phrases around each shorter one.
    inner = [
        F.struct(F.expr(f"array_join(slice(words, {at + 1}, {n}), ' ')").alias("phrase"), F.lit(at + n).alias("stop"))
        for n in range(2, longest)
        for at in range(longest - n + 1)
    ]
    around = (
        candidates.where("size > 2")
        .select("lang", "size", "a", F.split("phrase", " ").alias("words"))
        .select("lang", "size", "a", F.explode(F.array(*inner)).alias("inside"))
        .where("inside.stop <= size AND size(split(inside.phrase, ' ')) < size")
        .groupBy("lang", F.col("inside.phrase").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR CAST(longer AS decimal(20,0)) * 100 < CAST(a AS decimal(20,0)) * {covered}"
    )

    # Ranked in shards, then in fewer shards and at last as a whole, so that no task ranks all of a language.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (shards, math.isqrt(shards), 1):
        dealt = best.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(n)))
        within = Window.partitionBy("lang", "shard").orderBy(*order)
        best = dealt.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    return (
        best.join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


#: The same rows from DuckDB.
COLLOCATIONS_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
    SELECT lang, s.n AS size, array_to_string(w[i:i + s.n - 1], ' ') AS phrase
    FROM starts, (SELECT unnest([1, 2, 3, 4]) AS n) s WHERE i + s.n - 1 <= len(w)
), f AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), frequent AS (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE f >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
    FROM frequent c JOIN (SELECT unnest([1, 2, 3]) AS k) k ON k.k < c.size
    JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k.k], ' ')
    JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1:], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
    SELECT b.lang, array_to_string(b.w[i.i:i.i + n.n - 1], ' ') AS phrase, max(b.f) AS longer
    FROM frequent b, (SELECT unnest([1, 2, 3]) AS i) i, (SELECT unnest([2, 3]) AS n) n
    WHERE n.n < b.size AND i.i + n.n - 1 <= b.size GROUP BY ALL
), ranked AS (
    SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank,
        w.phrase, a, l, r, score
    FROM weakest w LEFT JOIN around x ON x.lang = w.lang AND x.phrase = w.phrase
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
