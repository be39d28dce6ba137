"""Trained models: gradients, decoding, held-out accuracy, and the exact patterns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from plumbline.llm import language, personal_data as pd_
from plumbline.llm.labelled import CARRIERS, examples
from plumbline.llm.language import ByteTagger, pieces_of, predict_languages
from pyspark.sql import functions as F

TABLES = "/root/testdata/sf0.01"


def test_recurrent_gradients():
    tagger = ByteTagger.fresh(["a", "b"], 5, 1, np.float64)
    table, lengths, _ = pieces_of([b"hello", b"de", b"x", b"abcdefghijklmnopqrstuvwxyz0123"])
    labels = np.array([0, 1, 0, 1, 1])
    rng = np.random.default_rng(0)
    _, grads = tagger.loss_and_gradients(table, lengths, labels)
    for weight, grad in zip(tagger.weights(), grads, strict=True):
        for at in rng.permutation(np.argwhere(np.abs(grad) > 1e-6))[:5]:
            at = tuple(at)
            weight[at] += 1e-6
            above = tagger.loss_and_gradients(table, lengths, labels)[0]
            weight[at] -= 2e-6
            below = tagger.loss_and_gradients(table, lengths, labels)[0]
            weight[at] += 1e-6
            assert abs((above - below) / 2e-6 - grad[at]) < 1e-6


def test_a_words_positions_do_not_depend_on_its_batch():
    tagger = ByteTagger.fresh(["a", "b", "c"], 6, 2, np.float64)
    words = [b"one", b"four", b"x" * 60, b"seven"]
    tagger.remember(words)
    for word in words:
        single = ByteTagger.fresh(["a", "b", "c"], 6, 2, np.float64)
        single.remember([word])
        np.testing.assert_allclose(single.sums[0], tagger.sums[tagger.known[word]])
        assert single.sums[0, -1] == len(word)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = predict_languages(docs).collect()
    assert len(found) == len(true)
    held = [r for r in found if r.held_out]
    assert 0.15 < len(held) / len(found) < 0.35
    assert np.mean([true[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_without_blanks_are_learned(spark):
    letters = {"th": "กขคงจฉชซญฎฏฐฑ", "ja": "あいうえおかきくけこさし", "en": "etaoinshrdlu"}
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        lang = list(letters)[i % 3]
        text = "".join(rng.choice(list(letters[lang]), 200))
        rows.append((i, " ".join(text[j : j + 6] for j in range(0, 200, 6)) if lang == "en" else text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words, labels = language.training_words(docs)
    assert set(labels) == set(letters) and max(map(len, words)) <= 2 * language.PIECE
    wrong = [r for r in predict_languages(docs).collect() if r.lang_pred != rows[r.doc_id][2]]
    assert not wrong


def test_languages_of_odd_rows(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the of and to", "en"), ("der die und das", "de")] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 +- 3", "de"), (None, "the and", None), (103, "und der " * 20_000, None)]
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in [*rows, *odd, odd[4]]], "doc_id long, text string, lang string, score double, id string")
    found = predict_languages(docs).collect()
    assert len(found) == 46
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by_id[100].score == 0
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False and by_id[103].lang_pred == "de"
    assert predict_languages(docs.limit(0)).count() == 0
    unlabelled = predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        found[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found[kind].append(m.span())
    return found


def test_patterns_equal_their_definition():
    rng = random.Random(4)
    alphabets = ["a@.b-1 ", "0123. -", "+0123456789() .-", "x@y.z+1_%é@@..", "1.2. ", "4 -"]
    for _ in range(6000):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert pd_.base_spans(text) == plain_spans(text), text
    text = "4111 1111-1111 1111 und 4111111111111111, +1 (555) 123-4567 1.2.3.4.5.6.7.8 256.1.1.1 a.b+c@d-e.f.g@h.i"
    assert pd_.base_spans(text) == plain_spans(text)
    # Long runs stay linear.
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000, "1 " * 100_000):
        pd_.base_spans(run)


@pytest.fixture(scope="module")
def random_field():
    texts = ["call +1 (017) 555-7713 now ok", "aa bb", "x 1234567890123456 a.b@c.de"]
    tokens = sorted((pd_.tokens_of(t.encode()) for t in texts), key=lambda t: -len(t.start))
    field = pd_.Field.fresh(np.unique(np.concatenate([t.shape for t in tokens])))
    rng = np.random.default_rng(1)
    for weight in [*field.tables, field.moves, field.first]:
        weight += rng.standard_normal(weight.shape)
    lengths = np.array([len(t.start) for t in tokens])
    return field, np.concatenate([field.features(t) for t in tokens], axis=1), np.cumsum(lengths) - lengths, lengths


def test_field_gradients(random_field):
    field, features, starts, lengths = random_field
    labels = np.random.default_rng(2).integers(0, len(pd_.LABELS), features.shape[1])
    _, grads = field.loss_and_gradients(features, labels, starts, lengths)
    for weight, grad in zip([*field.tables, field.moves, field.first], grads, strict=True):
        for at in map(tuple, np.argwhere(grad)[:6]):
            weight[at] += 1e-6
            above = field.loss_and_gradients(features, labels, starts, lengths)[0]
            weight[at] -= 2e-6
            below = field.loss_and_gradients(features, labels, starts, lengths)[0]
            weight[at] += 1e-6
            assert abs((above - below) / 2e-6 - grad[at]) < 1e-6


def test_viterbi_finds_the_best_of_all_paths(random_field):
    field, features, _, _ = random_field
    scores = field.scores(features)[:7]
    starts, lengths = np.array([0, 4]), np.array([4, 3])
    found = field.paths(scores, starts, lengths).tolist()
    for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        part = scores[start : start + n]

        def score(path, part=part):
            moves = sum(field.moves[a, b] for a, b in itertools.pairwise(path))
            return field.first[path[0]] + moves + sum(part[i, y] for i, y in enumerate(path))

        assert tuple(found[start : start + n]) == max(itertools.product(range(len(pd_.LABELS)), repeat=n), key=score)


def test_skipped_lines_have_no_labels(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    field = pd_.fit(docs)
    skipped = 0
    for row in docs.select("text").limit(100).collect():
        tokens = pd_.tokens_of(row.text.encode())
        scores = field.scores(field.features(tokens))
        firsts = np.flatnonzero(np.append(True, tokens.line[1:] != tokens.line[:-1]))
        lengths = np.diff(np.append(firsts, len(tokens.line)))
        dead = ~np.logical_or.reduceat(field.may_gain(scores), firsts)
        labels = field.paths(scores, firsts, lengths)
        for at, n in zip(firsts[dead].tolist(), lengths[dead].tolist(), strict=True):
            skipped += 1
            assert not labels[at : at + n].any()
    assert skipped > 100


def test_personal_data_rows(spark):
    card = "4111111111111111"
    texts = [f"mail a.b@c.de or 1.2.3.4.\nÜé {card} {card} and +1 (017) 555-7713", None, "", "nothing here", "12 " * 50_000]
    lines = [f"word other {kind} word and then" for kind in (card, "10.20.30.40", "x.y@mail.example.com", "+1 (234) 555-0199")]
    docs = spark.createDataFrame(
        [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(100 + i, lines[i % 4], None, i) for i in range(80)] + [(None, texts[0], "", 1)],
        "doc_id long, text string, spans string, n_email int",
    )
    found = pd_.personal_data(docs)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 86
    base = plain_spans(texts[0])
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == tuple(len(base[k]) for k in pd_.KINDS)
    # The patterns read the two cards as one number of 32 digits; the field finds both.
    assert base["card"] == [] and rows[0].spans.count("card:") == 2
    for i in (1, 2, 3, 4):
        assert rows[i].spans == "" and rows[i].n_card == 0
    assert rows[1].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pd_.personal_data(docs.limit(0)).count() == 0
    assert pd_.replaced(texts[0], rows[0].spans) == "mail <EMAIL> or <IP>.\nÜé <CARD> <CARD> and <PHONE>"
    assert pd_.replaced(None, "") is None


def test_training_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    words, labels = language.training_words(docs, documents=20, words=50)
    assert len(words) == 50 * len(set(labels))
    assert len(pd_.labelled_windows(docs, documents=50, windows=7, id_col="doc_id", text_col="text")) <= 7


def test_letters_are_unicode_letters(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ"), (3, "① 12 _"), (4, "ª"), (5, "ß"), (6, "日"), (7, None)]
    labelled = [(100 + i, "the words of a text", "en") for i in range(8)]
    df = spark.createDataFrame([(*r, None) for r in rows] + labelled, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in predict_languages(df).collect()}
    assert [found[i] for i in range(1, 8)] == ["und"] * 3 + ["en"] * 3 + ["und"]


def test_rows_that_share_an_id_are_drawn_by_their_texts(spark):
    rows = [(4 if i % 2 else 5, f"wort nummer {i} und noch eins", "de") for i in range(900)]
    rows += [(4, f"word number {i} and one more", "en") for i in range(900)]
    words, labels = language.training_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"de", "en"} == set(labels)
    assert len([x for x in labels if x == "de"]) > 1000 and len(words) == len(labels)


def test_held_out_rows_by_definition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.held_out for r in predict_languages(df).collect()}
    assert found == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in df.collect()}


def test_base_spans_of_documents_by_definition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in pd_.personal_data(df).collect()}
    some = 0
    for r in df.collect():
        spans = plain_spans(r.text)
        text = ",".join(f"{kind}:{a}:{b}" for kind in ("email", "ip", "card", "phone") for a, b in spans[kind])
        some += bool(text)
        got = found[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [len(spans[k]) for k in ("email", "ip", "card", "phone")]
    assert some > 3


def test_long_texts_with_many_spans_take_linear_time(monkeypatch):
    text = "Ümit a@b.com, call +49 30 1234567 or 555-1234 now. " * 20_000
    extra = [(m.start() + 1, m.end() + 1, "phone") for m in re.finditer("555-1234|1234567", text)]
    data = text.encode()
    shift = np.cumsum([len(c.encode()) - 1 for c in text])
    extra = [(a - 1 + int(shift[a - 1]), b - 1 + int(shift[b - 2]), k) for a, b, k in extra]
    monkeypatch.setattr(pd_, "field_spans", lambda model, texts: [extra])
    started = time.monotonic()
    ((base, both),) = pd_.all_spans(None, [text])
    assert time.monotonic() - started < 10
    added = sorted(set(both["phone"]) - set(base["phone"]))
    assert len(added) == 20_000 and {text[a:b] for a, b in added} == {"555-1234"} and len(data) > len(text)


def test_labelled_examples_are_what_the_patterns_leave_out():
    table = examples(3)
    assert table == examples(3) != examples(4)
    assert {kind for _, spans in table for _, _, kind in spans} == {"email", "ip", "phone"}
    for text, spans in table:
        assert not any(pd_.base_spans(text).values())
        assert all(pd_.plausible(kind, text[a:b]) for a, b, kind in spans)
    rows = pd_.labelled_rows([("Ü call (555) 123-4567.", [(7, 21, "phone")])])
    assert rows == [("Ü call (555) 123-4567.", [0, 0, pd_.LABELS.index("B-phone"), pd_.LABELS.index("I-phone")])]
    assert not pd_.plausible("email", "a[at]" * 100_000)


def test_field_finds_spans_in_sentences_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    windows = pd_.labelled_windows(docs, documents=4000, windows=4000, id_col="doc_id", text_col="text")
    learned = pd_.labelled_rows(examples(1, CARRIERS[::2], 20))
    field = pd_.train([(r.text, r.labels) for r in windows] + learned)
    held = examples(2, CARRIERS[1::2], 20)
    right = found = wanted = 0
    for (_, spans), (_, both) in zip(held, pd_.all_spans(field, [text for text, _ in held]), strict=True):
        got = {(a, b, kind) for kind, some in both.items() for a, b in some}
        right += len(got & set(spans))
        found += len(got)
        wanted += len(spans)
    assert right >= 0.98 * found and right >= 0.9 * wanted and wanted == 300
