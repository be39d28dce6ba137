"""Near duplicates and search against brute force."""

import re

import numpy as np
import pytest
import xxhash
from plumbline.llm.graph import components, local_components
from plumbline.llm.groups import join_by_key
from plumbline.llm.near_vectors import WIDTH, buckets, near_vectors, plan, sketch_limit, sketches
from plumbline.llm.simhash import fingerprint, near_duplicates, near_links, trie_pairs
from plumbline.llm.top_k import ImpactIndex, top_k
from pyspark.sql import functions as F


def classes(pairs):
    groups = {}
    for node, label in pairs:
        groups.setdefault(label, set()).add(node)
    return sorted(sorted(g) for g in groups.values())


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 30)]
    links = spark.createDataFrame([*chain, *star, (60, 61), (61, 62), (62, 60), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in range(1, 30)} == {1}
    assert {found[i] for i in (60, 61, 62)} == {60}
    assert components(links.limit(0)).count() == 0


def test_fingerprint_by_definition():
    text = "The  CAT\tsat\non the Mat\x0bÉ again the cat sat"
    words = "the cat sat on the mat É again the cat sat".split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) == want
    assert fingerprint("Two WORDS") == xxhash.xxh64_intdigest(b"two words", 42)
    assert fingerprint(" \n") == fingerprint(None) == 0


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    found = {0, 1, 7, 15, 2**64 - 1}
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64).tolist():
        for _ in range(40):
            value = base
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                value ^= 1 << int(bit)
            found.add(value)
    return np.array(sorted(found), np.uint64)


def brute_pairs(values, budget=3):
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    left, right = np.nonzero(np.triu(far <= budget, 1))
    return left, right


def test_trie_join_finds_every_pair(values):
    left, right = brute_pairs(values)
    found = set()
    for a, b in trie_pairs(values, np.zeros(len(values), int), 3):
        pairs = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        assert not pairs & found
        found |= pairs
    assert found == set(zip(left.tolist(), right.tolist(), strict=True))


@pytest.mark.parametrize("group_entries", [1000, 4])
def test_links_connect_what_brute_force_connects(spark, values, group_entries):
    signed = values.view(np.int64)
    entries = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    found = {r.node: r.component for r in components(near_links(entries, group_entries=group_entries)).collect()}
    want = local_components(len(values), *brute_pairs(values))
    assert classes((i, found.get(int(v), int(v))) for i, v in enumerate(signed)) == classes(enumerate(want.tolist()))


def test_near_duplicate_rows(spark):
    text = "one two three four five six seven eight nine ten " * 30
    rows = [(5, text), (2, text + "tail"), (9, "else " * 5 + "words and more of them here"), (1, None), (3, ""), (4, " \n")]
    rows += [(None, "only this"), (9, "else " * 5 + "words and more of them here"), (8, "x"), (7, "x")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, id int")
    found = near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id or 0), r.component_id) for r in found.collect())
    assert got == [(0, None), (1, 1), (2, 2), (3, 1), (4, 1), (5, 2), (7, 7), (8, 7), (9, 9), (9, 9)]
    assert all(len(r.fingerprint) == 16 for r in found.collect())
    assert near_duplicates(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, n_links string, v int, entry int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [centres[i % 40] + rng.standard_normal(16) * 0.09 for i in range(400)]
    rows += [rows[3], rows[3], 5 * rows[3]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    data += [(1000 + i, v) for i, v in enumerate(odd)] + [data[7], (None, data[3][1])]
    return spark.createDataFrame([(*d, "clash", 1, 2) for d in data], VECTORS)


@pytest.mark.parametrize("cell_entries", [1000, 5])
def test_near_vectors_against_all_pairs(vectors, cell_entries):
    found = near_vectors(vectors, cell_entries=cell_entries).collect()
    # Every row has one: vector 7 is there twice.
    assert len(found) == 403 + 7 + 2
    by_id = {r.vec_id: r for r in found}
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect() if r.vec_id is not None and r.vec_id < 1000}
    x = np.array([rows[i] / np.linalg.norm(rows[i]) for i in range(403)])
    near = x @ x.T >= 0.95
    ends = near.sum(1) - 1 + near[:, 7]
    np.fill_diagonal(near, False)
    links = np.array([by_id[i].n_links for i in range(403)])
    assert (links <= ends).all() and links.sum() >= 0.9 * ends.sum() and near.sum() > 1000
    assert len({(r.n_links, r.component_id) for r in found if r.vec_id == 7}) == 1 and links[7] >= 1
    want = local_components(403, *np.nonzero(near))
    assert np.mean(want == [by_id[i].component_id for i in range(403)]) > 0.97
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept for i in range(1000, 1007))
    assert by_id[None].n_links == 0 and by_id[None].component_id is None


@pytest.mark.parametrize("cell_entries", [1000, 7])
def test_near_vectors_count_each_pair_that_meets_once(spark, cell_entries):
    rng = np.random.default_rng(11)
    # Loose groups, a tight one that meets in every table, and vectors by themselves.
    x = [c + rng.standard_normal(24) * 0.06 for c in rng.standard_normal((12, 24)) for _ in range(20)]
    x += [x[0] + rng.standard_normal(24) * 0.001 for _ in range(60)] + list(rng.standard_normal((100, 24)))
    x = np.array(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in near_vectors(rows, cell_entries=cell_entries).collect()}
    met = buckets(x, *plan(len(x), 0.95), WIDTH, 7)
    linked = (met[:, None] == met[None]).any(axis=2) & (x @ x.T >= 0.95)
    np.fill_diagonal(linked, False)
    assert [found[i].n_links for i in range(len(x))] == linked.sum(1).tolist() and linked.sum() > 5000
    want = local_components(len(x), *np.nonzero(linked))
    assert [found[i].component_id for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("length", [3, 16, 200])
def test_sketches_keep_every_near_pair(length):
    rng = np.random.default_rng(length)
    x = rng.standard_normal((400, length))
    y = x + rng.standard_normal((400, length)) * rng.uniform(0, 0.5, (400, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    first, second = (sketches(v, 7).astype(int) for v in (x, y))
    limit = sketch_limit(0.95, first.shape[1]) ** 2
    near = (x * y).sum(1) >= 0.95
    assert (((first - second) ** 2).sum(1) <= limit)[near].all() and near.sum() > 50
    # Others hardly ever come as close.
    assert length < 16 or (((first - second[::-1]) ** 2).sum(1) > limit).mean() > 0.97


def test_keys_of_many_rows_are_joined_in_place(spark):
    rows = [("a", i) for i in range(3000)] + [(f"k{i}", i) for i in range(2000)] + [(None, 1), ("alone", 1)]
    rows = spark.createDataFrame(rows, "k string, n int")
    found = rows.groupBy("k").count().where("k <> 'alone'").select("k", F.col("count").alias("copies"))
    joined = join_by_key(rows, found, "k", 5002)
    assert joined.columns == ["k", "n", "copies"]
    want = rows.join(found, "k")
    assert joined.exceptAll(want).isEmpty() and want.exceptAll(joined).isEmpty() and want.count() == 5000
    assert found.where("copies * 1000 > 5002").count() == 1


def test_near_vectors_of_nothing(vectors):
    assert near_vectors(vectors.limit(0)).count() == 0
    assert near_vectors(vectors.where("vec_id = 1000")).count() == 1


def test_plan_grows_with_the_logarithm():
    (k1, t1), (k2, t2) = plan(10**4, 0.95), plan(10**8, 0.95)
    assert k2 == 2 * k1 or abs(k2 - 2 * k1) <= 1
    assert t2 < 12 * t1


def test_impact_index_is_exact():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[5]
    vectors, ids = np.floor(1024 * x).astype(np.int64), rng.permutation(9000)[:3000]
    index = ImpactIndex(vectors, ids)
    for q in [*range(20), 5, 150]:
        found, scores = index.top(vectors[q], int(ids[q]), 10)
        want = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -want)) if i != q][:10]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == want[order].tolist()


def best_of_all(rows, every, k=10):
    """Brute force over rows (id, vector): each query's best of all other rows."""
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, a) in enumerate(whole):
        if q % every == 0:
            others = [(i, b) for m, (i, b) in enumerate(whole) if m != n and len(a) == len(b)]
            scored = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in others)
            want += [(q, rank, i, -x) for rank, (x, i) in enumerate(scored[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_top_k_against_all_rows(vectors, shard_rows):
    found = top_k(vectors, shard_rows=shard_rows, query_every=50)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    usable = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding]
    want = best_of_all([(i, v) for i, v in usable if all(x is not None and np.isfinite(x) for x in v)], 50)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert top_k(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 3])
def test_top_k_scores_large_vectors_and_every_row(spark, shard_rows):
    rows = [(i, [float(i % 7), 0.25, float(-i)]) for i in range(1, 20)]
    rows += [(100, [300000.0, 0.001, 2.0]), (101, [-0.5, 3e5, 1.0]), (200, [0.5, 1.0, -1.0]), (5, [9.0, 9.0, -9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors, shard_rows=shard_rows).collect())) == best_of_all(rows, 100)


def test_top_k_counts_every_row(spark):
    a, b = [1.0, 0.5, 2.0], [0.25, 3.0, 1.0]
    rows = [(100, a), (100, b), (5, a), (5, a), (100, a), (7, b)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors).collect())) == best_of_all(rows, 100)


def test_fingerprints_of_documents_by_definition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.fingerprint for r in near_duplicates(df).collect()}
    for r in df.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text.translate({i: i + 32 for i in range(65, 91)}))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
        ones = np.zeros(64, np.int64)
        for s in shingles:
            ones += (np.uint64(xxhash.xxh64_intdigest(s.encode(), 42)) >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0
        want = sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(shingles))
        assert found[r.doc_id] == f"{want:016x}"
