"""Tokenizers, counts and packing against the libraries."""

import base64
import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from plumbline.llm.byte_bpe import Codec, encode_decode
from plumbline.llm.packing import ChunkEncoder, best_fit, choices, exchange, local_search, pack, pack_documents
from plumbline.llm.token_counts import ChunkCounter, token_counts
from tokenizers import Tokenizer

BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, DIGEST int, id int, length string, shard int"


def strange_texts(n=400):
    rng = random.Random(7)
    letters = "ab  \n  \x85\x1c\xa0 é'sté1²٣中文字🙂́\t,.-_<|>ABxyzÉÀßΣİ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += [f"a{chr(i)} b{chr(i)}{chr(i)}c {chr(i)}" for i in range(0, 0x3100, 3)]
    return [*texts, "", "a" * 1001, "ab" * 700, " " * 99, "xyxxyxyx" * 100, "x <|endoftext|> <|startoftext|>y", "  a   b"]


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["One two, three.", None, "", "One two, three.", "Ünï <|endoftext|> x", "word " * 9000, "a" * 50_000]
    rows = [(i, t, "clash", 1, 2, "clash", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id", None, None, None, None, None)], SCHEMA)


def test_chunk_counts_equal_the_library():
    counter, tokenizer = ChunkCounter(BYTE_JSON, remembered=50), Tokenizer.from_file(BYTE_JSON)
    for text in strange_texts():
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_a_task_counts_in_its_own_thread():
    # In a new process: threads that other tests started would hide those of the library.
    code = """
import os, sys
from plumbline.llm.token_counts import ChunkCounter
counter = ChunkCounter.of(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
counter.count(" ".join(f"w{i}" for i in range(10_000)))
print(len(os.listdir("/proc/self/task")) - before)
"""
    own = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    found = subprocess.run([sys.executable, "-c", code, BYTE_JSON], env=own, capture_output=True, text=True, timeout=120)
    assert found.stdout.strip() == "0", found.stderr


def test_merge_replay_equals_tiktoken():
    codec, texts = Codec(MULTI, public_tokenizers.PATTERN), strange_texts()
    with open(MULTI, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(texts, codec.encode_block(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_chunk_ids_equal_the_library():
    encoder, tokenizer = ChunkEncoder(WORD_JSON), Tokenizer.from_file(WORD_JSON)
    for text in strange_texts():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts_encode_only_misses(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    tokenizer = Tokenizer.from_file(BYTE_JSON)
    for _ in range(2):
        found = token_counts(documents, vocabulary=BYTE_JSON, cache=cache).collect()
        want = [
            (r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
            for r in documents.collect()
        ]
        assert sorted(map(repr, [(r.doc_id, r.n_bytes, r.n_tokens) for r in found])) == sorted(map(repr, want))
        assert all(r.over_limit == (r.n_tokens > 512) for r in found)
        # Six distinct contents besides the empty one; the second run adds none.
        assert spark.read.parquet(cache).count() == 6
    assert token_counts(documents.limit(0), vocabulary=BYTE_JSON, cache=cache).count() == 0


def test_encode_decode_rows(spark, documents):
    found = encode_decode(documents, vocabulary=MULTI, pattern=public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 8 and rows[1].n_tokens == rows[2].n_tokens == 0
    for r in documents.collect():
        assert bytes(rows[r.doc_id].decoded) == (r.text or "").encode()
        ids = np.array(rows[r.doc_id].ids, "<u4").tobytes()
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()


@pytest.mark.parametrize("low, high", [(1, 4097), (1000, 2100), (1, 50), (4096, 4097), (1366, 1367)])
def test_local_search_keeps_every_item(low, high):
    rng = random.Random(low)
    lengths = [rng.randrange(low, high) for _ in range(600)]
    start = best_fit(lengths, 4096)
    bins = local_search([list(b) for b in start], lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(600))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= len(start)
    assert len(best_fit([], 4096)) == 0 and local_search([], [], 4096) == []


def test_local_search_empties_a_bin():
    # Filled as given, two bins are wasted; exchanges find the exact fit.
    lengths = [6, 3, 5, 4, 7, 2, 3]
    bins = local_search([[0, 1], [2, 3], [4], [5], [6]], lengths, 10)
    assert len(bins) == 3 and all(sum(lengths[i] for i in b) == 10 for b in bins)


def test_packed_documents(spark, documents):
    found = [r for r in pack_documents(documents, vocabulary=WORD_JSON).collect()]
    tokenizer = Tokenizer.from_file(WORD_JSON)
    want = []
    for r in documents.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found])) == sorted(map(repr, want))
    check_sequences(found)
    assert pack_documents(documents.limit(0), vocabulary=WORD_JSON).count() == 0


def check_sequences(rows, capacity=4096):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_shards_are_packed_again_across(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "pmod(id * 7919, 997) + 1 AS length")
    rows = pack(pieces, capacity=4096, shard_pieces=256).collect()
    assert len(rows) == 3000
    total = sum(r.length for r in rows)
    assert check_sequences(rows) <= -(-total // 4096) + 1


def test_search_goes_on_until_nothing_improves():
    rng = random.Random(4)
    lengths = [rng.randint(1025, 2047) for _ in range(400)]
    bins = local_search(best_fit(lengths, 4096), lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(400))
    every = [choices(b, lengths) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    for d, offers in enumerate(every):
        sizes = [n for n, _ in offers]
        for b, back in enumerate(every):
            if b != d and fill[d] <= fill[b]:
                assert exchange(offers, sizes, back, 4096 - fill[b]) is None


def test_pairs_of_a_bin_of_many_small_pieces_are_offered():
    lengths = [1] * 60 + [2, 3]
    assert [n for n, _ in choices(list(range(62)), lengths)] == [1, 2, 2, 3, 3, 4, 5]


def test_shards_are_even_however_rows_lie(spark):
    pieces = spark.range(2048).repartition(512).selectExpr("id", "CAST(100 + id % 900 AS long) AS length")
    rows = pack(pieces, capacity=4096, shard_pieces=64, loose=0).collect()
    sizes = Counter(r.sequence_id >> 33 for r in rows)
    assert len(sizes) == 32 and max(sizes.values()) <= 2 * 64
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 2048 and max(fill.values()) <= 4096
