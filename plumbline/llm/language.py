"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends and gives every position a distribution over
languages; a document's probabilities are the mean over all its positions. As the network starts
anew at each word, a worker runs each distinct word once and remembers its sums, and a document of
any length costs one look-up per word. It is trained in numpy by backpropagation through time on a
bounded sample of labelled words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from plumbline.llm.memory import release
from pyspark.sql import DataFrame, Window, functions as F

#: Unicode's letters; numbers such as ½ or Ⅷ are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Longer words are read in pieces of this many bytes.
PIECE = 24
#: Words a worker remembers; beyond that it starts anew. It bounds memory and changes no result.
REMEMBERED_WORDS = 250_000
#: Bounds of the training sample: documents looked into and words taken, per language.
TRAINING_DOCUMENTS = 400
TRAINING_WORDS = 6000


def pieces_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (n x PIECE), lengths and word numbers of all pieces, longest pieces first."""
    parts, owner = [], []
    for i, word in enumerate(words):
        for at in range(0, len(word), PIECE):
            parts.append(word[at : at + PIECE])
            owner.append(i)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    table = np.zeros((len(parts), PIECE), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    table[np.arange(PIECE) < lengths[:, None]] = flat
    order = np.argsort(-lengths, kind="stable")
    return table[order], lengths[order], np.array(owner, np.int64)[order]


def reverse(table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``length`` entries the other way round."""
    at = np.maximum(lengths[:, None] - 1 - np.arange(table.shape[1]), 0)
    return np.take_along_axis(table, at.reshape(at.shape + (1,) * (table.ndim - 2)), 1)


@dataclass
class Gru:
    """One direction. Inputs are rows of a table per byte; gates are in the order update, reset, new."""

    inputs: np.ndarray  # 256 x 3h
    hidden: np.ndarray  # h x 3h

    def forward(self, table: np.ndarray, active: list[int]) -> tuple[np.ndarray, list]:
        """States (n x T x h) and what the way back needs; ``active`` pieces are left at each step."""
        h = self.hidden.shape[0]
        states = np.zeros((len(table), len(active), h), self.hidden.dtype)
        before = np.zeros((len(table), h), self.hidden.dtype)
        kept = []
        for t, n in enumerate(active):
            x, before = self.inputs[table[:n, t]], before[:n]
            u = before @ self.hidden
            gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + u[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            state = z * before + (1 - z) * new
            kept.append((before, z, r, new, u[:, 2 * h :]))
            states[:n, t] = before = state
        return states, kept

    def backward(self, table: np.ndarray, active: list[int], kept: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of inputs and hidden, for gradients of all states."""
        h = self.hidden.shape[0]
        d_inputs, d_hidden = np.zeros_like(self.inputs), np.zeros_like(self.hidden)
        carry = np.zeros((0, h), self.hidden.dtype)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            before, z, r, new, un = kept[t]
            d = grads[:n, t].copy()
            d[: len(carry)] += carry
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_inputs, table[:n, t], d_x)
            d_hidden += before.T @ d_u
            carry = d * z + d_u @ self.hidden.T
        return [d_inputs, d_hidden]


@dataclass
class ByteTagger:
    """Both directions and the layer that labels every position."""

    languages: list[str]
    ahead: Gru
    back: Gru
    out_ahead: np.ndarray
    out_back: np.ndarray
    bias: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)
    sums: np.ndarray | None = None

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int, dtype=np.float32) -> ByteTagger:
        rng = np.random.default_rng(seed)

        def random(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(dtype)

        grus = [Gru(random(256, 3 * hidden, scale=0.3), random(hidden, 3 * hidden, scale=hidden**-0.5)) for _ in "ab"]
        outs = [random(hidden, len(languages), scale=0.1) for _ in "ab"]
        return cls(languages, *grus, *outs, np.zeros(len(languages), dtype))

    def weights(self) -> list[np.ndarray]:
        return [
            self.ahead.inputs, self.ahead.hidden, self.back.inputs, self.back.hidden,
            self.out_ahead, self.out_back, self.bias,
        ]

    def positions(self, table: np.ndarray, lengths: np.ndarray):
        """Probabilities (n x T x languages) and what the gradient needs."""
        steps = int(lengths[0])
        table, inside = table[:, :steps], np.arange(steps) < lengths[:, None]
        active = inside.sum(0).tolist()
        turned = reverse(table, lengths)
        ahead, kept_ahead = self.ahead.forward(table, active)
        back, kept_back = self.back.forward(turned, active)
        back = reverse(back, lengths)
        logits = ahead @ self.out_ahead + back @ self.out_back + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p *= inside[:, :, None]
        return p, (table, turned, inside, active, ahead, back, kept_ahead, kept_back)

    def loss_and_gradients(self, table: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
        """Mean cross entropy over all positions and its gradient per weight."""
        p, (table, turned, inside, active, ahead, back, kept_ahead, kept_back) = self.positions(table, lengths)
        total = inside.sum()
        right = np.take_along_axis(p, labels[:, None, None], 2)[:, :, 0]
        loss = -np.log(np.maximum(right[inside], 1e-30)).sum() / total
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(labels[:, None, None], (*d.shape[:2], 1)), (right - inside)[:, :, None], 2)
        d /= d.dtype.type(total)
        flat = d.reshape(-1, d.shape[2])
        d_ahead = self.ahead.backward(table, active, kept_ahead, d @ self.out_ahead.T)
        d_back = self.back.backward(turned, active, kept_back, reverse(d @ self.out_back.T, lengths))
        outs = [x.reshape(-1, x.shape[2]).T @ flat for x in (ahead, back)]
        return loss, [*d_ahead, *d_back, *outs, flat.sum(0)]

    def remember(self, words: list[bytes], block: int = 2048) -> None:
        """Add each word's probabilities, summed over its positions, and their number."""
        added = np.zeros((len(words), len(self.languages) + 1))
        table, lengths, owner = pieces_of(words)
        for at in range(0, len(table), block):
            part = slice(at, at + block)
            p = self.positions(table[part], lengths[part])[0].sum(axis=1)
            np.add.at(added, owner[part], np.column_stack([p, lengths[part]]))
        for word in words:
            self.known[word] = len(self.known)
        self.sums = added if self.sums is None else np.concatenate([self.sums, added])

    def pooled(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each text."""
        # Without an argument, bytes.split() splits at ASCII white space alone.
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        split = [text.encode().split() if LETTER.search(text) else [] for text in texts]
        fresh = [w for w in set().union(*split) if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED_WORDS:
            self.known, self.sums = {}, None
            fresh = list(set().union(*split))
        if fresh:
            self.remember(fresh)
        out = []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.sums[list(map(self.known.__getitem__, words))].sum(axis=0)
            p = total[:-1] / total[-1]
            best = int(p.argmax())
            out.append((self.languages[best], min(1.0, float(p[best]))))
        return out


def train(words: list[bytes], labels: list[str], *, hidden: int = 16, steps: int = 300, batch: int = 512, seed: int = 3) -> ByteTagger:
    """Fit on labelled words by Adam; every language is drawn equally often."""
    languages = sorted(set(labels))
    tagger = ByteTagger.fresh(languages, hidden, seed)
    if not languages:
        return tagger
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    table, lengths, owner = pieces_of(words)
    label = np.array([number[x] for x in labels], np.int64)[owner]
    share = 1.0 / np.bincount(label, minlength=len(languages))[label]
    share /= share.sum()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in tagger.weights()]
    for step in range(1, steps + 1):
        chosen = np.sort(rng.choice(len(table), batch, p=share))  # pieces stay longest first
        _, grads = tagger.loss_and_gradients(table[chosen], lengths[chosen], label[chosen])
        rate = 0.02 * (1 - 0.9 * step / steps)
        for w, g, (m, v) in zip(tagger.weights(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


def is_held_out(id_col: str):
    """Whether a row's id is in the quarter that is never learned from; a null id counts as not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_words(
    df: DataFrame, *, documents: int = TRAINING_DOCUMENTS, words: int = TRAINING_WORDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[list[bytes], list[str]]:
    """At most ``words`` labelled words per language, from about ``documents`` texts that are not held out.

    Runs without a blank that are longer than two pieces count as several words.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").where(~is_held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, documents / n))])
    # Rows that share an id are drawn by their texts.
    place = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    texts = rows.where(place < share[F.col("lang")])
    runs = texts.select("lang", F.xxhash64("id", "text").alias("row"), F.posexplode(F.split("text", "[ \\t-\\r]+")).alias("at", "run"))
    runs = runs.withColumn("run", F.col("run").cast("binary")).where(F.octet_length("run") > 0)
    # Cut where pieces_of() cuts: scripts without blanks are learned from such parts.
    parts = F.sequence(F.lit(0), F.floor((F.octet_length("run") - 1) / (2 * PIECE)).cast("int"))
    taken = runs.select("lang", "row", "at", "run", F.explode(parts).alias("part"))
    word = F.substring("run", F.col("part") * (2 * PIECE) + 1, F.lit(2 * PIECE)).alias("word")
    place = F.xxhash64("row", "at", "part").alias("place")
    order = Window.partitionBy("lang").orderBy("place", "word")
    taken = taken.select("lang", place, word).withColumn("n", F.row_number().over(order)).where(F.col("n") <= words)
    found = taken.select("lang", "word").orderBy("lang", "word").collect()
    return [bytes(r["word"]) for r in found], [r["lang"] for r in found]


def identify(df: DataFrame, tagger: ByteTagger, *, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row, computed from the text alone; keeps the row's columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts = ["" if t is None else t for t in batch.column(text_col).to_pylist()]
            for at in range(0, len(texts), 500):
                found += tagger.pooled(texts[at : at + 500])
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])
        tagger.known, tagger.sums = {}, None
        release()

    rows = df.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, lang_pred string, score double")


def predict_languages(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    documents: int = TRAINING_DOCUMENTS, words: int = TRAINING_WORDS, seed: int = 3,
) -> DataFrame:
    """(id, held_out, lang_pred, score): train on the rows that are not held out, predict all rows.

    A text that is null or holds no letter is ``und`` with score 0, as is every text if no row has
    a label to learn from. Rows with a null id are predicted but never learned from. Repeated rows
    are predicted alike; on a tie the language that sorts first wins. An empty table gives no rows;
    other columns are ignored, whatever their names. Trains eagerly on the driver.
    """
    learned = training_words(df, documents=documents, words=words, id_col=id_col, text_col=text_col, lang_col=lang_col)
    tagger = train(*learned, seed=seed)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = identify(rows, tagger)
    return found.select(F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "lang_pred", "score")
