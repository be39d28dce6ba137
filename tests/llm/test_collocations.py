"""Collocations against brute force."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm.collocations import at_cuts, block_of, collocations, frequent_phrases, table_of, words_and_cuts

UPPER = {i: i + 32 for i in range(65, 91)}
COLUMNS = "doc_id long, text string, lang string"
SMALL = {"least": 6, "table_bits": 1 << 16}


def brute_counts(rows, longest=4):
    f = {}
    for _, text, lang in rows:
        mine = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            mine[()] += len(words)
            for n in range(1, longest + 1):
                mine.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return f


def brute(rows, least, longest=4, covered=80, top=2000):
    out = []
    for lang, f in brute_counts(rows, longest).items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        lines = []
        for p, a in found.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            around = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * found[q] >= covered * a for q in around):
                lines.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        lines.sort()
        out += [(lang, i + 1, x[3], -x[1], x[4], x[5], f[()], -x[0]) for i, x in enumerate(lines[:top])]
    return sorted(out)


def found(df, **options):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in collocations(df, **options).select(columns).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["New", "york", "Öl", "ÖL", "a\x1cb", "x\xa0y", "'s", "\x00"]
    fixed = ["New York city hall", "a b a b a", "once upon a time", "same same same same same"]
    rows = []
    for i in range(260):
        parts = [rng.choice(fixed) if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randrange(0, 25))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [rows[3]] * 8
    rows += [(None, None, "en"), (901, "", "xx"), (902, "lonely words", "yy"), (903, "tick tock " * 3000, "en")]
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"sample_of": 10**9},  # an empty sample: every frequent phrase is a failure of its border
        {"sample_of": 1, "lowered": 3.0},  # proposes too little
        {"table_bits": 1 << 7},  # nearly every bit is set
        {"chunk_words": 50},
    ],
)
def test_phrases_equal_brute_force(spark, rows, options):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {(r.lang, r.phrase, r["size"]): r.f for r in frequent_phrases(df, **(SMALL | options)).collect()}
    want = {}
    for lang, f in brute_counts(rows).items():
        want |= {(lang, " ".join(p), len(p)): a for p, a in f.items() if p and a >= 6}
        want[lang, "", 0] = f[()]
    assert got == want


def test_collocations_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert found(df, **SMALL) == brute(rows, 6)
    assert found(df, **SMALL, top=3, covered=50, longest=3) == brute(rows, 6, longest=3, covered=50, top=3)
    assert found(df) == brute(rows, 30)


def test_clashing_names_and_an_empty_table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], f"{COLUMNS}, size int, phrase string, f int")
    assert found(df, **SMALL) == brute(rows, 6)
    assert found(df.limit(0), **SMALL) == []


def test_long_texts_are_parted_at_cuts():
    ids = np.array([5, 6, 0, 7, 8, 9, 1, 2, 0, 0, 3, 0], np.int32)
    for most in (1, 2, 4, 7, 100):
        parts = list(at_cuts(ids, most))
        assert np.concatenate(parts).tolist() == ids.tolist()
        assert all(p[-1] == 0 for p in parts)
    assert [len(p) for p in at_cuts(ids, 4)] == [3, 6, 3]
    assert list(at_cuts(ids[:0], 4)) == []


def test_words_and_cuts():
    assert words_and_cuts("A  b\tC.d\x0c\x1ce") == [b"a", b"b", b"c", b"\xff", b"d", b"\xff", b"\x1ce", b"\xff"]
    assert words_and_cuts("") == [b"\xff"]
    assert np.frombuffer(b"".join(words_and_cuts("ÀB")), np.uint8).tolist() == [0xC3, 0x80, 98, 255]


def test_blocks_hold_keys_and_counts():
    odd = ["", "\n", "en\n", "en\n", "en\nab", "en\na", "en\nabcdefghij", "en\nabcdefghijk", "é\nÖ", "é\nÜ", "und\n\x00", "z"]
    for keys in (odd, sorted(odd), odd[::-1], ["only"], [""], ["same"] * 300, ["a\n" + "x" * 70_000, "a\n" + "x" * 70_001]):
        counts = np.array([1, 300, 70_000, 1 << 40][: len(keys)] + [1] * (len(keys) - 4), np.int64)
        for start in (0, len(keys) // 2):
            table = table_of(block_of(pa.array(["before", *keys], pa.string()).slice(1 + start), counts[start:]))
            assert table.column("key").to_pylist() == keys[start:]
            assert table.column("f").to_pylist() == counts[start:].tolist() and table.schema.field("f").type == pa.int64()


def test_blocks_leave_out_what_sorted_keys_share():
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(3000)]
    keys = sorted({f"en\n{rng.choice(words[:300])} {rng.choice(words)}" for _ in range(5000)})
    counts = np.array([1 if rng.random() < 0.9 else rng.randrange(50) for _ in keys], np.int64)
    lengths = np.array([len(k) for k in keys], "<i4")
    one_frame = pa.compress(lengths.tobytes() + counts.tobytes() + "".join(keys).encode(), codec="zstd", asbytes=True)
    assert len(block_of(pa.array(keys), counts)) < 0.8 * len(one_frame)


def test_frequent_phrases_are_kept_once(spark, rows):
    def folders():
        top = spark.sparkContext.getCheckpointDir()
        return len([name for name in os.listdir(top.removeprefix("file:")) if name.startswith("rdd-")]) if top else 0

    before = folders()
    assert found(spark.createDataFrame(rows, COLUMNS).repartition(3), **SMALL, sample_of=10**9) == brute(rows, 6)
    # One for each of the two full passes.
    assert folders() - before == 2
