"""Line deduplication against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from plumbline.llm.line_dedup import drop_repeated_lines, keep_bitmaps, kept_lines

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least_chars=20, least_docs=3):
    """The contract, line by line; None is the smallest id."""
    size = lambda i: (i is not None, i)
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, lines in texts:
        for line in lines:
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, lines in texts:
        kept = []
        for line in lines:
            k = key(line)
            if len(k) >= least_chars and len(holders[k]) >= least_docs and i != max(holders[k], key=size):
                continue
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common = [f"A line that many documents share, number {i}" for i in range(12)]
    odd = ["", " ", "short", "Ümläute zählen als ein Zeichen", "é" * 19, "é" * 20, "İstanbul İstanbul İstanbul", "\x0b\x0c"]
    rows = []
    for i in range(300):
        lines = [rng.choice(common + odd + [f"only in document {i} and nowhere else"]) for _ in range(rng.randrange(1, 9))]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (400, ""), (401, None), (9, rows[9][1])]
    rows.append((500, "\n".join(f"row {i} of a very long document" for i in range(20_000)) + "\n" + common[0]))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_equal_brute_force_however_ranges_cut_a_key(spark, rows, parts):
    # One key in every document: its rows fill several parts.
    rows = [(i, f"{t or ''}\nThe one line that everybody has in common") for i, t in rows]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(drop_repeated_lines(df)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nulls_repeats_and_clashing_names(spark, rows):
    df = spark.createDataFrame(
        [(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, id string, h1 int, keep int"
    )
    assert found(drop_repeated_lines(df)) == brute(rows)
    assert found(drop_repeated_lines(df.limit(0))) == []
    same = [(3, "exactly the same line of text")] * 5
    assert {r[2] for r in found(drop_repeated_lines(spark.createDataFrame(same, "doc_id long, text string")))} == {0}


def test_ids_of_text(spark):
    rows = [(x, "the same line in all of these") for x in "cab"]
    got = found(drop_repeated_lines(spark.createDataFrame(rows, "doc_id string, text string")))
    assert [(r[0], r[2]) for r in got] == [("a", 1), ("b", 1), ("c", 0)]


def test_bitmaps(spark):
    line = "this line is in three documents"
    rows = [(1, f"x\n{line}\ny"), (2, f"{line}\n{line.upper()} "), (3, line)]
    maps = {r.id: r.keep for r in keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(maps) == {1, 2}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(maps[1])), np.uint8))
    assert bits.tolist() == [1, 0, 1, 1, 1, 1, 1, 1]
    assert kept_lines(rows[0][1], bytes(maps[1])) == (3, 1, b"x\ny")
    assert kept_lines(rows[1][1], bytes(maps[2])) == (2, 2, b"")
    assert kept_lines("a\nb", None) == (2, 0, b"a\nb")
