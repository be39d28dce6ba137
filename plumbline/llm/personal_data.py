"""Personal data: exact patterns, and spans that a linear-chain conditional random field adds.

The field labels white-space separated tokens of a line by their shapes and those of their
neighbours. It is trained on a small table: token windows labelled by the patterns, and labelled
examples of what the patterns leave out beside look-alikes; it finds such spans. Shapes, scores and Viterbi paths are computed in numpy for all lines
of a batch. A line in which no token can gain by any label is left alone; a bound proves that the
unlabelled path is its best one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from plumbline.llm.labelled import examples
from plumbline.llm.memory import release
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

#: Patterns of the contract (fixed values). The email is found from its "@", see ``emails``.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match can't start inside a run of digits: from the run's start there would be one further left.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Bounds of the labelled table: documents looked into, windows kept and their length in tokens.
TRAINING_DOCUMENTS = 4000
TRAINING_WINDOWS = 4000
WINDOW = 24
#: Bytes of text that a worker's arrays cover at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows of the labelled examples for each form; their seed.
EXAMPLES = 20
EXAMPLES_SEED = 1

#: Mail addresses with their marks spelled out in brackets; no address is longer (fixed value).
MAIL_CHARS = 320
SPELLED_MAIL = re.compile(r"\S+? ?[\[({]at[\])}] ?\S+?(?: ?[\[({]dot[\])}] ?|\.)\S+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the local part, "@" and a domain with a dot.

    A local part holds no "@", so a match starts where the run of its characters before an "@"
    starts, or where the last match ended.
    """
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return found


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Each kind's spans in code points; matches that fail a kind's test are dropped."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    for m in IP.finditer(text):
        # Leading zeros don't count; very long parts are not turned into numbers.
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                found["card"].append(m.span())
    return found


def failed_spans(text: str) -> dict[str, list[Span]]:
    """Matches of the number patterns that fail their kind's test, if they are long enough to be one."""
    good = base_spans(text)
    found = {}
    for kind, pattern, least in (("ip", IP, 7), ("card", CARD, 13), ("phone", PHONE, 8)):
        spans = (m.span() for m in pattern.finditer(text))
        found[kind] = [(a, b) for a, b in spans if b - a >= least and (a, b) not in good[kind]]
    return found


# Shapes. Classes of bytes: blanks, line ends, capitals, other letters, digits, and each mark.
BLANK, LINE, UPPER, LETTER, DIGIT = range(5)
CLASSES = np.full(256, LETTER, np.uint8)
for _byte in range(128):
    _char = chr(_byte)
    if _char in "\n\r\x0b\x0c":
        CLASSES[_byte] = LINE
    elif _char in " \t":
        CLASSES[_byte] = BLANK
    elif _char.isupper():
        CLASSES[_byte] = UPPER
    elif _char.isdigit():
        CLASSES[_byte] = DIGIT
    elif not _char.islower():
        CLASSES[_byte] = 5 + _byte
#: Presence flags of a token: these classes, any mark besides.
FLAGS = [UPPER, LETTER, DIGIT, 5 + ord("@"), 5 + ord("."), 5 + ord("+"), 5 + ord("-")]
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)
DIGIT_STEPS = np.array([1, 2, 4, 5, 8, 10, 12, 16, 17, 20])


@dataclass
class Tokens:
    """Tokens of a block of text: byte bounds, line number, shape, flags and digits."""

    start: np.ndarray
    stop: np.ndarray
    line: np.ndarray
    shape: np.ndarray
    flags: np.ndarray
    digits: np.ndarray


def tokens_of(text: bytes) -> Tokens:
    """Split at ASCII white space; a shape is a hash of the runs of equal class in a token."""
    kind = CLASSES[np.frombuffer(text, np.uint8)]
    inside = kind >= UPPER
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none.astype(np.uint64), none, none)
    stop = np.flatnonzero(before & ~inside)
    if len(stop) < len(start):
        stop = np.append(stop, len(kind))
    breaks = np.flatnonzero(kind == LINE)
    line = np.searchsorted(breaks, start)
    new = inside & np.append(True, kind[1:] != kind[:-1])
    runs = np.flatnonzero(new)
    classes = kind[runs]
    first = np.searchsorted(runs, start)
    counts = np.diff(np.append(first, len(runs)))
    place = np.arange(len(runs)) - np.repeat(first, counts)
    part = (classes.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(place, 63)]
    shape = np.add.reduceat(part, first)
    flags = np.zeros(len(start), np.int64)
    for bit, c in enumerate(FLAGS):
        flags |= (np.add.reduceat((classes == c).astype(np.int64), first) > 0).astype(np.int64) << bit
    other = (classes >= 5) & ~np.isin(classes, FLAGS)
    flags |= (np.add.reduceat(other.astype(np.int64), first) > 0).astype(np.int64) << len(FLAGS)
    number = np.append(0, np.cumsum(kind == DIGIT))
    digits = np.searchsorted(DIGIT_STEPS, number[stop] - number[start], side="right")
    return Tokens(start, stop, line, shape, flags, digits)


@dataclass
class Field:
    """Weights: per known shape at a token, before it and after it, per flags, per digits."""

    shapes: np.ndarray  # sorted hashes; number 0 stands for every other shape
    tables: list[np.ndarray]
    moves: np.ndarray  # label x label
    first: np.ndarray

    @classmethod
    def fresh(cls, shapes: np.ndarray) -> Field:
        k, m = len(shapes) + 2, len(LABELS)
        sizes = [k, k, k, 1 << (len(FLAGS) + 1), 1 << (len(FLAGS) + 1), 1 << (len(FLAGS) + 1), len(DIGIT_STEPS) + 1]
        return cls(shapes, [np.zeros((n, m)) for n in sizes], np.zeros((m, m)), np.zeros(m))

    def features(self, tokens: Tokens) -> np.ndarray:
        """Rows of ``tables`` for each token; neighbours are those of its line."""
        at = np.minimum(np.searchsorted(self.shapes, tokens.shape), max(0, len(self.shapes) - 1))
        known = self.shapes[at] == tokens.shape if len(self.shapes) else np.zeros(len(at), bool)
        own = np.where(known, at + 1, 0)
        edge = len(self.shapes) + 1
        joined = np.append(False, tokens.line[1:] == tokens.line[:-1])  # to the token before
        previous = np.where(joined, np.roll(own, 1), edge)
        following = np.where(np.roll(joined, -1), np.roll(own, -1), edge)
        flags_before = np.where(joined, np.roll(tokens.flags, 1), 0)
        flags_after = np.where(np.roll(joined, -1), np.roll(tokens.flags, -1), 0)
        return np.stack([own, previous, following, tokens.flags, flags_before, flags_after, tokens.digits])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(table[rows] for table, rows in zip(self.tables, features, strict=True))

    def may_gain(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that could lie on a better path than the one without labels.

        Each labelled token pays for one move into it, and at worst gains one move out of it.
        """
        stay = self.moves[0, 0]
        into = max(self.moves[:, 1:].max() - stay, (self.first[1:] - self.first[0]).max())
        out = max(0.0, self.moves[1:, 0].max() - stay)
        return scores[:, 1:].max(axis=1) - scores[:, 0] + into + out >= 0

    def paths(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of the tokens of the given lines (0 elsewhere), by Viterbi for all lines at once."""
        labels = np.zeros(len(scores), np.int8)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        if not len(starts):
            return labels
        best = self.first + scores[starts]
        trail: list[np.ndarray] = []
        finals = np.zeros(len(starts), np.int8)
        active = len(starts)
        for t in range(1, int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # lines longer than t
            finals[n:active] = best[n:active].argmax(axis=1)
            active = n
            reach = best[:n, :, None] + self.moves
            trail.append(reach.argmax(axis=1).astype(np.int8))
            best = reach.max(axis=1) + scores[starts[:n] + t]
        finals[:active] = best[:active].argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            labels[starts[:n] + t] = finals[:n]
            if t:
                finals[:n] = trail[t - 1][np.arange(n), finals[:n]]
        return labels

    def loss_and_gradients(self, features: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Negative log likelihood per line of lines sorted by falling length, and its gradients."""
        scores = self.scores(features)
        count = len(starts)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
        alpha = [self.first + scores[starts]]
        for t in range(1, len(active)):
            n = active[t]
            reach = alpha[-1][:n, :, None] + self.moves
            top = reach.max(axis=1)
            alpha.append(top + np.log(np.exp(reach - top[:, None]).sum(axis=1)) + scores[starts[:n] + t])
        d_scores, d_moves = np.zeros_like(scores), np.zeros_like(self.moves)
        beta, norm = np.zeros((0, len(LABELS))), np.zeros(count)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            after = len(beta)
            back = np.zeros((n, len(LABELS)))
            ending = alpha[t][after:n]
            top = ending.max(axis=1)
            norm[after:n] = top + np.log(np.exp(ending - top[:, None]).sum(axis=1))
            if after:
                ahead = self.moves + (scores[starts[:after] + t + 1] + beta)[:, None, :]
                top = ahead.max(axis=2)
                back[:after] = top + np.log(np.exp(ahead - top[:, :, None]).sum(axis=2))
                joint = np.exp(alpha[t][:after, :, None] + ahead - norm[:after, None, None])
                d_moves += joint.sum(axis=0)
            d_scores[starts[:n] + t] = np.exp(alpha[t] + back - norm[:n, None])
            beta = back
        loss = norm.sum()
        first = d_scores[starts].sum(axis=0)
        inner = np.ones(len(scores), bool)
        inner[starts] = False
        at = np.arange(len(scores))
        loss -= scores[at, labels].sum() + self.first[labels[starts]].sum()
        loss -= self.moves[labels[at[inner] - 1], labels[inner]].sum()
        d_scores[at, labels] -= 1
        np.subtract.at(first, labels[starts], 1)
        np.subtract.at(d_moves, (labels[at[inner] - 1], labels[inner]), 1)
        d_tables = []
        for table, rows in zip(self.tables, features, strict=True):
            d = np.zeros_like(table)
            np.add.at(d, rows, d_scores)
            d_tables.append(d / count)
        return loss / count, [*d_tables, d_moves / count, first / count]


def byte_bounds(text: str, spans: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
    """Spans in UTF-8 bytes."""
    if text.isascii():
        return [(a, b, kind) for kind, found in spans.items() for a, b in found]
    at = np.append(0, np.cumsum([len(c.encode()) for c in text]))
    return [(int(at[a]), int(at[b]), kind) for kind, found in spans.items() for a, b in found]


#: A row of the labelled table has no more bytes; longer windows hold runs that no kind can be.
WINDOW_BYTES = 4096


def labelled_windows(df: DataFrame, *, documents: int, windows: int, id_col: str, text_col: str) -> list:
    """The labelled table: at most ``windows`` rows (text, labels) of ``WINDOW`` tokens at most.

    About ``documents`` texts, chosen by a hash of the id, are labelled by the patterns. Windows
    around labels and other unusual tokens come first, then one plain window in fifty. A window
    with a match that failed its kind's test is left out: nothing is known about its tokens.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    share = min(1.0, documents / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("labelled")), F.lit(1_000_000)) < share * 1_000_000)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                raw = text.encode()
                tokens = tokens_of(raw)
                labels = np.zeros(len(tokens.start), np.int64)
                for a, b, kind in byte_bounds(text, base_spans(text)):
                    hit = np.flatnonzero((tokens.start < b) & (tokens.stop > a))
                    labels[hit] = 2 + 2 * KINDS.index(kind)
                    labels[hit[:1]] -= 1
                unsure = np.zeros(len(tokens.start), bool)
                for a, b, _ in byte_bounds(text, failed_spans(text)):
                    unsure |= (tokens.start < b) & (tokens.stop > a)
                for at in range(0, len(labels), WINDOW):
                    stop = at + int((tokens.line[at : at + WINDOW] == tokens.line[at]).sum())
                    part = slice(at, stop)
                    rank = 0 if labels[part].any() else 1 if (tokens.digits[part] > 0).any() else 2
                    piece = raw[tokens.start[at] : tokens.stop[stop - 1]]
                    if len(piece) <= WINDOW_BYTES and not unsure[part].any():
                        out.append((rank, piece.decode(errors="replace"), labels[part].tolist()))
            yield pd.DataFrame(out, columns=["rank", "text", "labels"])

    found = chosen.select("text").mapInPandas(work, "rank int, text string, labels array<int>")
    place = F.xxhash64("text")
    found = found.where((F.col("rank") < 2) | (F.pmod(place, F.lit(50)) == 0))
    return found.orderBy("rank", place, "text").limit(windows).collect()


def labelled_rows(table: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[str, list[int]]]:
    """Rows (text, spans) of one line each as rows (text, labels of its tokens)."""
    out = []
    for text, spans in table:
        tokens = tokens_of(text.encode())
        labels = np.zeros(len(tokens.start), np.int64)
        for a, b, kind in byte_bounds(text, {k: [(a, b) for a, b, other in spans if other == k] for k in KINDS}):
            hit = np.flatnonzero((tokens.start < b) & (tokens.stop > a))
            labels[hit] = 2 + 2 * KINDS.index(kind)
            labels[hit[:1]] -= 1
        out.append((text, labels.tolist()))
    return out


def train(table: list[tuple[str, list[int]]], *, epochs: int = 40, batch: int = 256, decay: float = 1e-4, seed: int = 5) -> Field:
    """Fit the field to (text, labels) rows by Adam on the likelihood."""
    parsed = [(tokens_of(text.encode()), labels) for text, labels in table]
    parsed = [(t, labels) for t, labels in parsed if len(t.start) == len(labels) and labels]
    shapes, seen = np.unique(np.concatenate([t.shape for t, _ in parsed] or [np.zeros(0, np.uint64)]), return_counts=True)
    model = Field.fresh(shapes[seen >= 2])
    # Before it has learned anything, nothing is labelled.
    model.first[0] = model.moves[:, 0] = 1.0
    if not parsed:
        return model
    featured = [(model.features(t), np.array(labels, np.int64)) for t, labels in parsed]
    rng = np.random.default_rng(seed)
    weights = [*model.tables, model.moves, model.first]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step, total = 0, epochs * -(-len(featured) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(featured))
        for at in range(0, len(order), batch):
            lines = sorted((featured[i] for i in order[at : at + batch]), key=lambda x: -len(x[1]))
            lengths = np.array([len(labels) for _, labels in lines])
            features, labels = (np.concatenate([x[i] for x in lines], axis=-1) for i in (0, 1))
            _, grads = model.loss_and_gradients(features, labels, np.cumsum(lengths) - lengths, lengths)
            step += 1
            rate = 0.05 * (1 - 0.95 * step / total)
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                g = g + decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def field_spans(model: Field, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
    """What the field labels in each text, as byte spans without marks at either end."""
    joined = b"\n".join(texts)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    tokens = tokens_of(joined)
    if not len(tokens.start):
        return found
    scores = model.scores(model.features(tokens))
    firsts = np.flatnonzero(np.append(True, tokens.line[1:] != tokens.line[:-1]))
    lengths = np.diff(np.append(firsts, len(tokens.line)))
    live = np.logical_or.reduceat(model.may_gain(scores), firsts)
    labels = model.paths(scores, firsts[live], lengths[live])
    hits = np.flatnonzero(labels)
    if not len(hits):
        return found
    kind = (labels[hits] - 1) // 2
    begins = (labels[hits] % 2 == 1) | np.append(True, (np.diff(hits) > 1) | (np.diff(kind) != 0))
    begins |= np.append(True, tokens.line[hits[1:]] != tokens.line[hits[:-1]])
    heads = np.flatnonzero(begins)
    tails = np.append(heads[1:], len(hits)) - 1
    for k, a, b in zip(kind[heads].tolist(), tokens.start[hits[heads]].tolist(), tokens.stop[hits[tails]].tolist(), strict=True):
        doc = int(np.searchsorted(offsets, a, side="right")) - 1
        start, stop = a - int(offsets[doc]), b - int(offsets[doc])
        piece = texts[doc][start:stop]
        core = piece.lstrip(MARKS_BEFORE)
        start += len(piece) - len(core)
        stop = start + len(core.rstrip(MARKS_AFTER))
        if start < stop:
            found[doc].append((start, stop, KINDS[k]))
    return found


MARKS_AFTER = bytes(b for b in range(33, 127) if not chr(b).isalnum())
MARKS_BEFORE = MARKS_AFTER.replace(b"+", b"").replace(b"(", b"")


def plausible(kind: str, piece: str) -> bool:
    """The test of a kind, for what the field labels; it doesn't ask for the pattern's form."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "email":
        return "@" in piece[1:-1] and "." in piece or (len(piece) <= MAIL_CHARS and SPELLED_MAIL.fullmatch(piece) is not None)
    if kind == "ip":
        parts = piece.replace("[.]", ".").split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and passes_luhn(digits)
    return 7 <= len(digits) <= 15


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(model: Field, texts: list[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """Per text the pattern spans, and with them the field's plausible spans that overlap none of them."""
    raw = [t.encode() for t in texts]
    out = []
    for text, data, extra in zip(texts, raw, field_spans(model, raw), strict=True):
        base = base_spans(text)
        both = {kind: list(found) for kind, found in base.items()}
        starts, ends = merged([span for found in base.values() for span in found])
        # Code points that begin before each byte; in ASCII text they are the bytes.
        before = None
        if extra and len(data) != len(text):
            heads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            before = np.append(0, np.cumsum(heads))
        for a, b, kind in extra:
            start, stop = (a, b) if before is None else (int(before[a]), int(before[b]))
            at = bisect_left(starts, stop) - 1
            if plausible(kind, text[start:stop]) and (at < 0 or ends[at] <= start):
                both[kind].append((start, stop))
        out.append((base, {kind: sorted(found) for kind, found in both.items()}))
    return out


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def blocks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def fit(
    df: DataFrame, *, documents: int = TRAINING_DOCUMENTS, windows: int = TRAINING_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Field:
    """Train the field on the labelled examples and bounded windows of ``df``; runs eagerly, on the driver."""
    table = labelled_windows(df, documents=documents, windows=windows, id_col=id_col, text_col=text_col)
    return train([(r["text"], r["labels"]) for r in table] + labelled_rows(examples(EXAMPLES_SEED, each=EXAMPLES)))


def find_personal_data(df: DataFrame, model: Field, *, text_col: str = "text", mask: bool = False) -> DataFrame:
    """Adds base_spans and spans to every row: "kind:start:end" in code points, joined by commas.

    Spans stand by kind (email, ip, card, phone), then start; ends are exclusive. ``spans`` holds
    the pattern spans and what the field adds. A null or empty text has no spans; repeated rows
    get equal spans; an empty table gives no rows. The row's other columns are kept, but columns
    of the two names are replaced. With ``mask``, each span of the text is replaced by its kind in
    angle brackets, overlapping spans by one; the spans are those of the text before.
    """
    rows = df.drop("base_spans", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start = batch.schema.get_field_index(text_col), 0
            texts = batch.column(at).to_pylist()
            for block in blocks(["" if t is None else t for t in texts]):
                found = all_spans(model, block)
                columns = list(batch.slice(start, len(block)).columns)
                added = [[written(x[i]) for x in found] for i in (0, 1)]
                if mask:
                    pairs = zip(texts[start : start + len(block)], added[1], strict=True)
                    columns[at] = pa.array([replaced(t, s) for t, s in pairs], pa.string())
                columns += [pa.array(x, pa.string()) for x in added]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "base_spans", "spans"])
                start += len(block)
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, base_spans string, spans string")


def replaced(text: str | None, spans: str) -> str | None:
    if not spans or text is None:
        return text
    parts, end = [], 0
    for start, stop, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if start >= end:
            parts += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; the counts are of pattern spans.

    Rows with null or repeated ids are handled like any other.
    """
    model = fit(df, id_col=id_col, text_col=text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find_personal_data(rows, model)
    counts = [F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
