"""Source divergence against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from plumbline.llm.divergence import TermTree, divergence, gaps, shares, terms

UPPER = {i: i + 32 for i in range(65, 91)}
COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs=3, top=200):
    docs = [((t or "").translate(UPPER), la or "", s or "") for _, t, la, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), s) for t, la, s in docs if la == lang]
        seen = Counter(w for words, _ in mine for w in set(words))
        kept = {w for w, n in seen.items() if n >= least_docs}
        counts = {s: Counter() for _, s in mine}
        for words, s in mine:
            counts[s].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())

        def p(count, word, kept=kept):
            return 1 + 10**9 * (count[word] + 1) // (sum(count.values()) + len(kept))

        share = {s: {w: p(c, w) for w in kept} for s, c in counts.items()}
        of_lang = {w: p(whole, w) for w in kept}
        for s in counts:
            pairs = [(o, sum((share[s][w] - share[o][w]) ** 2 // share[o][w] for w in kept)) for o in counts if o != s]
            found = [
                (w, (share[s][w] - of_lang[w]) ** 2 // of_lang[w]) for w in kept if counts[s][w] and share[s][w] > of_lang[w]
            ]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", found, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:limit])]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "The", "cat", "Öl", "öl", "naïve", "x", "İ", "日本", "dog's", "a1b", "", "--", "😀"]
    words += [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words[: rng.choice([6, 14, len(words)])]) for _ in range(rng.randrange(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None, ""])))
    rows += [rows[0]] * 3
    rows += [(900, None, "en", "silent"), (901, "rare words only here", "xx", "one"), (902, "", "xx", "two")]
    rows += [(903, "lonely", "yy", "alone"), (None, "the cat", "en", "s1"), (904, "the cat " * 5000, "en", "s2")]
    return rows


def test_rows_equal_brute_force(spark, rows):
    got = found(spark.createDataFrame(rows, COLUMNS).repartition(7))
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "xx"} == {0}
    assert not [r for r in got if r[0] == "yy"]


def test_clashing_names_an_empty_table_and_limits(spark, rows):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], f"{COLUMNS}, n int, term string")
    assert found(df, least_docs=1, top_terms=3) == brute(rows, least_docs=1, top=3)
    assert found(df.limit(0)) == []


def test_terms():
    assert [t.decode() for t in terms("The cat's\x7fÉté né\x00z")] == ["the", "cat", "s", "Été né", "z"]


def test_shares_are_exact_for_large_totals():
    total = 9 * 10**15
    counts = np.array([0, 1, 10**15, total - 1, 8_999_999_999_999_998], np.int64)
    assert shares(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


def test_tree_shares_paths_and_sums_corrections():
    rows = [[(0, 2), (1, 1)], [(0, 2), (1, 1), (2, 4)], [(0, 2), (2, 4)], [(1, 3)], []]
    times = np.array([5, 2, 1, 7, 4])
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    items = np.array([x for r in rows for x in r], np.int64)
    tree = TermTree(offsets, items[:, 0], items[:, 1], times)
    assert [sorted(zip(*(x.tolist() for x in level), strict=True)) for level in tree.levels] == [
        [(0, 0, 2, 8), (0, 1, 3, 7)],
        [(0, 1, 1, 7), (0, 2, 4, 1)],
        [(0, 2, 4, 2)],
    ]
    kept = int(times.sum())
    totals = np.array([sum(t * dict(r).get(s, 0) for r, t in zip(rows, times.tolist(), strict=True)) for s in range(3)]) + kept
    sums = np.zeros((3, 3), np.int64)
    tree.corrections(totals, sums)
    p = np.array([[shares(np.array([dict(r).get(s, 0)]), totals[s])[0] for s in range(3)] for r in rows])
    none = shares(np.zeros(3, np.int64), totals)
    for g in range(3):
        for h in range(3):
            if g != h:
                want = sum(t * int(gaps(p[r, g], p[r, h]) - gaps(none[g], none[h])) for r, t in enumerate(times.tolist()))
                assert sums[g, h] == want
