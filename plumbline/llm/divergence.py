"""How far the sources of a language diverge in their words, by a tree of term rows.

A term row lists the sources of a language that use a term, in a fixed order, with their counts. Rows
are inserted into a prefix tree with multiplicities, so terms that agree in their first sources and
counts share a path. The divergence of two sources is what it would be if neither used any term, plus
a correction for each source alone (from the totals of the tree's items) and one for both (from
every node and each of its ancestors, once per such pair however many terms pass through).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import cut_lineage

#: What a smoothed share is a multiple of: one billionth.
SCALE_STEPS, SCALE_STEP = 3, 1000
#: Distinct (lang, source, term) entries a task collects before it hands them on.
HELD_ENTRIES = 400_000
#: Entries of term rows that are put into one tree.
TREE_ENTRIES = 1_000_000
#: The table of sources is broadcast to the join with terms up to this many rows, and shuffled beyond.
BROADCAST_SOURCES = 100_000

#: Term bytes stay, A-Z lower-cased; all others separate. All bytes of non-ASCII code points are term bytes.
TERM_BYTES = bytes(
    b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order: letters A-Z and a-z and everything beyond ASCII."""
    return text.encode().translate(TERM_BYTES).split()


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exactly, for totals up to 9 * 10^15."""
    whole, rest = np.zeros_like(count), count + 1
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        whole = whole * SCALE_STEP + rest // total
        rest = rest % total
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit into 64 bits."""
    return (p - q) ** 2 // q


def term_counts(df: DataFrame, *, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up for the part a task has read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                words = list(n)
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()),
                            pa.array([source] * len(some), pa.string()),
                            pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([n[w] for w in some], pa.int64()),
                            pa.array([docs[w] for w in some], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for lang, source, text in zip(*columns, strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > HELD_ENTRIES:
                yield from flush()
        yield from flush()

    rows = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def term_rows(counts: DataFrame, *, least_docs: int = 3) -> DataFrame:
    """(lang, term, n, row): each kept term with its count and its (source, n), in the order of sources."""
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_source.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("n"),
            F.sum("docs").alias("docs"),
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row"),
        )
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )


class TermTree:
    """A prefix tree of rows of (source, count): for each level its nodes' parents, items and multiplicities."""

    def __init__(self, offsets: np.ndarray, sources: np.ndarray, counts: np.ndarray, times: np.ndarray):
        """Row r holds the items offsets[r] to offsets[r + 1] and occurs times[r] times."""
        lengths = np.diff(offsets)
        node = np.zeros(len(lengths), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > depth)
            at = offsets[rows] + depth
            keys = np.array([node[rows], sources[at], counts[at]])
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            fresh = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
            number = np.empty(len(rows), np.int64)
            number[order] = np.cumsum(fresh) - 1
            multiplicity = np.zeros(int(fresh.sum()), np.int64)
            np.add.at(multiplicity, number, times[rows])
            node[rows] = number
            self.levels.append((*keys[:, fresh], multiplicity))

    def corrections(self, totals: np.ndarray, sums: np.ndarray) -> None:
        """Add to sums[g, h] what terms used by g, by h or by both change in their divergence.

        ``totals`` has each source's occurrences plus the number of kept terms.
        """
        n = len(totals)
        nothing = shares(np.zeros(n, np.int64), totals)
        base = gaps(nothing[:, None], nothing[None, :])
        for depth, (parent, source, count, times) in enumerate(self.levels):
            p = shares(count, totals[source])
            # One source alone: equal items of a level are one.
            key = np.array([source, count])
            order = np.lexsort(key)
            fresh = np.append(True, (key[:, order][:, 1:] != key[:, order][:, :-1]).any(axis=0))
            starts = np.flatnonzero(fresh)
            weight = np.add.reduceat(times[order], starts)
            for at in range(0, len(starts), 4096):
                some = order[starts[at : at + 4096]]
                g, times_here = source[some], weight[at : at + 4096]
                np.add.at(sums, g, times_here[:, None] * (gaps(p[some][:, None], nothing) - base[g]))
                np.add.at(sums.T, g, times_here[:, None] * (gaps(nothing, p[some][:, None]) - base.T[g]))
            # Both: each node with each of its ancestors.
            above = parent
            for upper in range(depth - 1, -1, -1):
                up_parent, up_source, up_count, _ = self.levels[upper]
                h = up_source[above]
                q = shares(up_count[above], totals[h])
                for one, other, x, y in ((source, h, p, q), (h, source, q, p)):
                    both = gaps(x, y) - gaps(x, nothing[other]) - gaps(nothing[one], y) + base[one, other]
                    np.add.at(sums, (one, other), times * both)
                above = up_parent[above]


def pair_sums(patterns: DataFrame, groups: dict[str, dict[str, int]], kept: dict[str, int]) -> DataFrame:
    """(lang, source, item, value): each task's corrections for the pairs of sources its trees touch.

    ``patterns`` has (lang, row, times). ``groups`` has each language's sources with their occurrences;
    it is sent to the tasks, and the result has a row for every two of them.
    """
    shared = patterns.sparkSession.sparkContext.broadcast((groups, kept))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, terms_of = shared.value
        held: dict[str, list[tuple]] = {}
        sums: dict[str, np.ndarray] = {}
        names = {lang: sorted(of, key=str.encode) for lang, of in occurrences.items()}
        codes = {lang: {s: i for i, s in enumerate(of)} for lang, of in names.items()}
        totals = {
            lang: np.array([occurrences[lang][s] for s in of], np.int64) + terms_of.get(lang, 0)
            for lang, of in names.items()
        }

        def plant(lang: str) -> None:
            parts = held.pop(lang)
            offsets = np.append(0, np.cumsum(np.concatenate([np.diff(o) for o, _, _, _ in parts])))
            tree = TermTree(offsets, *(np.concatenate([part[i] for part in parts]) for i in (1, 2, 3)))
            if lang not in sums:
                sums[lang] = np.zeros((len(totals[lang]), len(totals[lang])), np.int64)
            tree.corrections(totals[lang], sums[lang])

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                chosen = batch.filter(pa.array(langs.indices.to_numpy() == code))
                rows = chosen.column("row")
                offsets = rows.value_lengths().to_numpy().astype(np.int64).cumsum()
                items = rows.flatten()
                name = items.field("source").dictionary_encode()
                code_of = np.array([codes[lang][s] for s in name.dictionary.to_pylist()], np.int64)
                held.setdefault(lang, []).append(
                    (
                        np.append(0, offsets),
                        code_of[name.indices.to_numpy()],
                        items.field("n").to_numpy().astype(np.int64),
                        chosen.column("times").to_numpy().astype(np.int64),
                    )
                )
                if sum(len(s) for _, s, _, _ in held[lang]) >= TREE_ENTRIES:
                    plant(lang)
        for lang in list(held):
            plant(lang)
        for lang, found in sums.items():
            g, h = np.nonzero(found)
            other = g != h
            g, h = g[other], h[other]
            listed = pa.array(names[lang], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), listed.take(pa.array(g)), listed.take(pa.array(h))]
                + [pa.array(found[g, h])],
                ["lang", "source", "item", "value"],
            )

    return patterns.select("lang", "row", "times").mapInArrow(
        work, "lang string, source string, item string, value long"
    )


def share(count: str, total: str) -> F.Column:
    """The same share in SQL; decimals keep products beyond 64 bits exact."""
    return F.expr(f"1 + ((CAST({count} AS decimal(20,0)) + 1) * 1000000000bd) div CAST({total} AS decimal(20,0))")


def gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 3,
    top_terms: int = 200,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ from others' of its language.

    Terms are kept per language if at least ``least_docs`` of its documents (rows) have them. Part
    ``pair`` ranks all other sources of the language, part ``term`` the ``top_terms`` kept terms that
    the source has more of than its language. Values fall by rank, ties by item.

    Null texts, languages and sources count as empty strings, and an empty name is a name like any
    other. A source without terms is compared as well; a language without kept terms has value 0 for all its
    pairs. Repeated rows are documents of their own. An empty table gives no rows; other columns are
    ignored. Runs eagerly: term rows are checkpointed, and every (lang, source) goes to the driver and
    the tasks. The result has a row for every two sources of a language; a task holds as many sums.
    """
    rows = cut_lineage(
        term_rows(term_counts(df, text_col=text_col, lang_col=lang_col, source_col=source_col), least_docs=least_docs)
    )
    used = rows.select("lang", F.explode("row").alias("item")).groupBy("lang", "item.source")
    used = used.agg(F.sum("item.n").alias("n"))
    named = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    ).distinct()
    listed = named.join(used, ["lang", "source"], "left").fillna(0, "n")
    vocabulary = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups: dict[str, dict[str, int]] = {}
    for r in listed.collect():
        groups.setdefault(r.lang, {})[r.source] = r.n
    kept = {r.lang: r.kept for r in vocabulary.collect()}
    spark = df.sparkSession
    schema = "lang string, source string, total long, lang_total long, kept long"
    sizes = spark.createDataFrame(
        [
            (lang, source, n + kept.get(lang, 0), sum(of.values()) + kept.get(lang, 0), kept.get(lang, 0))
            for lang, of in groups.items()
            for source, n in of.items()
        ],
        schema,
    )

    small = F.broadcast(sizes) if sum(map(len, groups.values())) <= BROADCAST_SOURCES else sizes
    patterns = rows.groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times"))
    found = pair_sums(patterns, groups, kept)
    # If no source used any term: the same gap for each kept term.
    left, right = sizes.alias("a"), sizes.alias("b")
    base = (
        left.join(right, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
        .select(
            "a.lang",
            "a.source",
            F.col("b.source").alias("item"),
            "a.kept",
            F.when(F.col("a.kept") > 0, share("0", "a.total")).alias("p"),
            F.when(F.col("a.kept") > 0, share("0", "b.total")).alias("q"),
        )
        .select("lang", "source", "item", F.coalesce(F.col("kept") * gap("p", "q"), F.lit(0)).alias("value"))
    )
    exact = F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    pairs = found.unionByName(base).groupBy("lang", "source", "item").agg(exact)

    items = rows.select("lang", F.col("term").alias("item"), F.col("n").alias("in_lang"), F.explode("row").alias("of"))
    scored = (
        items.select("lang", "of.source", "item", "in_lang", "of.n")
        .join(small, ["lang", "source"])
        .select("lang", "source", "item", share("n", "total").alias("p"), share("in_lang", "lang_total").alias("q"))
        .where("p > q")
        .select("lang", "source", "item", gap("p", "q").alias("value"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    number = F.row_number().over(by_value).alias("rank")
    top = scored.select("*", number).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.select("*", number)
        .withColumn("part", F.lit("pair"))
        .select(columns)
        .unionByName(top.withColumn("part", F.lit("term")).select(columns))
    )


#: The same rows from DuckDB.
DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), named AS (
    SELECT lang, source, coalesce(any_value(v.v), 0)::HUGEINT AS v, coalesce(any_value(v.n), 0)::HUGEINT AS n
    FROM docs LEFT JOIN v USING (lang) GROUP BY lang, source
), totals AS (
    SELECT named.lang, named.source, named.v, named.n AS lang_n, coalesce(sum(counts.n), 0)::HUGEINT AS n
    FROM named LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + t.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (t.lang_n + t.v) AS q
    FROM totals t JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pair_values AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_values x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
