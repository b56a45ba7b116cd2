"""Language identification: forward-backward by enumeration, the gradient's effect, held-out accuracy, defined results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import langid

SYLLABLES = {"aa": ["ka", "ko", "ki", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["ção", "nho", "lhe", "que"]}


def sentence(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], size=rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    rows = [(sentence(lang, rng, 40), lang) for lang in SYLLABLES for _ in range(15)]
    return langid.fit(*zip(*rows))


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    lengths, begins = np.array([4, 2, 1]), np.array([0, 4, 6])
    em, start, trans = rng.random((7, 3)), rng.random(3), rng.random((3, 3))
    gamma, both = langid.forward_backward(em, lengths, begins, start, trans, pairs=True)
    want, pairs = np.zeros_like(em), np.zeros((3, 3))
    for b, n in zip(begins, lengths):
        total, here, steps = 0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = start[path[0]] * np.prod([em[b + t, k] for t, k in enumerate(path)]) * np.prod([trans[i, j] for i, j in zip(path, path[1:])])
            total += p
            for t, k in enumerate(path):
                here[t, k] += p
            for i, j in zip(path, path[1:]):
                steps[i, j] += p
        want[b : b + n], pairs = here / total, pairs + steps / total
    assert np.allclose(gamma, want) and np.allclose(both, pairs)


def test_features_stay_within_words_and_texts():
    feats, begins, hashes, words = langid.word_features(["Ab c", "", "c", "12 !"])
    assert words.tolist() == [2, 0, 1, 0] and hashes[1] == hashes[2] and len(begins) == 3
    one = [set(row[begins[2] :]) - {1 << langid.BITS} for row in feats]
    two = [set(row[begins[1] : begins[2]]) - {1 << langid.BITS} for row in feats]
    assert one == two


def test_switched_text_is_labelled_word_by_word(model):
    rng = np.random.default_rng(9)
    text = sentence("aa", rng, 12) + " " + sentence("cc", rng, 6) + " " + sentence("bb", rng, 20)
    ((_, lang, score, gamma),) = langid.label([text], model)
    want = ["aa"] * 12 + ["cc"] * 6 + ["bb"] * 20
    assert np.mean([model.langs[k] == w for k, w in zip(gamma.argmax(axis=1), want)]) > 0.9
    assert lang == "bb" and 0.4 < score < 0.7
    assert all(model.trans[k, k] > model.trans[k].mean() for k in range(3))


def test_batches_do_not_matter(model):
    rng = np.random.default_rng(2)
    texts = [sentence(lang, rng, int(n)) for lang, n in zip(rng.choice(list(SYLLABLES), 30), rng.integers(1, 300, 30))]
    whole = {k: (lang, round(score, 9)) for k, lang, score, _ in langid.label(texts, model)}
    parts = {k: (lang, round(score, 9)) for k, lang, score, _ in langid.label(texts, model, size=500)}
    alone = {k: next((lang, round(score, 9)) for _, lang, score, _ in langid.label([t], model)) for k, t in enumerate(texts)}
    assert whole == parts == alone


def test_documents(spark):
    rng = np.random.default_rng(5)
    names = list(SYLLABLES)
    rows = [(k, sentence(names[k % 3], rng, int(rng.integers(3, 80))), names[k % 3] if k % 7 else None, "x") for k in range(300)]
    rows += [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, "12 -- !!", "cc", "x"), (903, "—…", None, "x"), (None, rows[4][1], "bb", "x"), (4, rows[4][1], "bb", "x"), (904, "ka" * 60_000, None, "x"), (905, "schein " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = langid.identify(docs, langid.train(docs, per_lang=50)).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    assert set(got[got.doc_id.between(900, 903)].lang_pred) == {"und"} and (got[got.doc_id.between(900, 903)].score == 0).all()
    assert got[got.doc_id == 904].lang_pred.item() == "aa" and got[got.doc_id == 905].lang_pred.item() == "bb"
    back = got[got.held_out & (got.doc_id < 300)]
    assert len(back) > 50 and np.mean([names[int(i) % 3] == p for i, p in zip(back.doc_id, back.lang_pred)]) > 0.97
    assert got.score.between(0, 1).all()
    kept = langid.keep_known(docs, langid.train(docs, per_lang=50))
    assert kept.columns == docs.columns and kept.where("doc_id BETWEEN 900 AND 903").count() == 0


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "xx")], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    only = langid.fit(["some text", "more"], ["xx", "xx"])
    assert [x[1:3] for x in langid.label(["any"], only)] == [("xx", 1.0)]


def test_every_language_is_learned(spark):
    rows = [(100 * k + j, " ".join([chr(0x4E00 + 50 * k + i) * 2 for i in range(6)] * 3), f"l{k:02}") for k in range(70) for j in range(8 if k < 66 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 70
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_known_does_not_depend_on_the_number_of_languages(spark):
    names = [f"l{k}" for k in range(5)]
    even = langid.Model(names, np.zeros(((1 << 15) + 1, 5)), np.zeros(0, dtype=np.uint64), np.zeros((1, 5)), np.zeros(5), np.zeros((5, 5)))
    docs = spark.createDataFrame([(1, "some words"), (2, "12 --"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_known(docs, even).collect()] == [1]


def test_no_letters_is_und_whatever_the_numerals(spark, model):
    texts = ["½ ² ①", "12 ?!", "①②③", "", None, "ⅷ 7", "_ — ’", "ka — ko"]
    got = {k: (lang, score) for k, lang, score, _ in langid.label(texts, model)}
    assert [got[k] for k in range(7)] == [("und", 0.0)] * 7 and got[7][0] == "aa"
    *_, words = langid.word_features(["ka—ko", "ka ko", "“ka” ko", "ka\u00a0ko", "ção"])
    assert words.tolist() == [2, 2, 2, 2, 1]


def brute_label(text, model):
    """Language and score by loops over words and their byte windows, in double precision."""
    spaced = "".join(c if langid.LETTER.match(c) or ord(c) > 127 and not langid.OTHER.match(c) else " " for c in text.lower())
    words = ["".join(w).encode() for w in spaced.split(" ") if w]
    bits, size = len(model.weight).bit_length() - 1, len(model.langs)
    ems = []
    for w in words:
        s, total = b" " + w + b" ", np.zeros(size)
        for n in range(1, 5):
            for at in range(len(s) - n + 1):
                part = s[at : at + n]
                if n == 1 and part == b" ":
                    continue
                x = ((int.from_bytes(part, "big") + (n - 1) * 0x3C6EF372) * 0x9E3779B1) % 2**32
                x = ((x ^ (x >> 15)) * 0x85EBCA77) % 2**32
                total += model.weight[x >> (32 - bits)]
        hashes = langid.word_features([w.decode()])[2]
        total += model.word_weight[model.lexicon_rows(hashes)[0]]
        ems.append(np.exp(np.maximum(total - total.max(), -40)))
    start, trans, n = np.exp(model.start), np.exp(model.trans), len(words)
    ahead, back = [start * ems[0]], [np.ones(size)]
    for t in range(1, n):
        ahead.append((ahead[-1] / ahead[-1].sum()) @ trans * ems[t])
        back.append(trans @ (back[-1] / back[-1].sum() * ems[n - t]))
    marginals = [a * b / (a * b).sum() for a, b in zip(ahead, reversed(back))]
    mean = np.mean(marginals, axis=0)
    return model.langs[int(mean.argmax())], float(mean.max())


def test_documents_are_labelled_as_by_loops(spark, model):
    rng = np.random.default_rng(4)
    texts = [sentence(lang, rng, n) for lang in SYLLABLES for n in (1, 2, 30)] + [sentence("aa", rng, 20) + ". " + sentence("bb", rng, 25), "Ção, ÉCOLE 12 ung!", "日本語 テスト ka"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for k, text in enumerate(texts):
        lang, score = brute_label(text, model)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-4)


def test_more_than_64_languages_are_all_learned(spark):
    rng = np.random.default_rng(8)
    letters = [a + b for a in "bcdfghjk" for b in "aeiouxyzw"][:70]
    rows = [(k * 70 + j, " ".join(s * int(rng.integers(1, 3)) for _ in range(12)), f"l{j}") for k in range(30) for j, s in enumerate(letters)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70


def test_long_texts_lose_no_language(spark):
    rng = np.random.default_rng(5)
    short = [(k, sentence("aa", rng, 20), "en") for k in range(200)]
    long = [(1000 + k, " ".join([sentence("bb", rng, 40)] * 2000), "de") for k in range(12)]
    model = langid.train(spark.createDataFrame(short + long, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    mixed = [(2000 + k, sentence("bb", rng, 20), "de") for k in range(60)] + [(3000, " ".join([sentence("bb", rng, 40)] * 20_000), "de")]
    docs = spark.createDataFrame(short + mixed, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {k: lang for k, _, lang in short + mixed}


def test_segments_are_spread_over_the_text(spark):
    text = "".join(f"{k:04}" for k in range(1000))
    got = spark.createDataFrame([(text,), ("short",), ("",)], "t string").select(langid.segments(F.col("t"), 80).alias("s")).collect()
    parts = got[0].s.split(" ")
    assert [len(p) for p in parts] == [10] * 8 and text.startswith(parts[0]) and text.endswith(parts[-1]) and got[1].s == "short" and got[2].s == ""


@pytest.mark.parametrize("n,piece", [(1, None), (2, 1), (7, 3), (50, 7), (50, 100), (400, None)])
def test_chain_in_pieces_has_the_same_marginals(n, piece):
    rng = np.random.default_rng(n)
    em, start, trans = np.exp(-30 * rng.random((n, 3))), rng.random(3) + 0.1, rng.random((3, 3)) + 0.05
    want, _ = langid.forward_backward(em, np.array([n]), np.array([0]), start, trans)
    assert np.allclose(langid.chain_marginals(em, start, trans, piece), want, atol=1e-12)


def test_long_texts_are_labelled_in_blocks(model):
    rng = np.random.default_rng(6)
    texts = [sentence("aa", rng, 60) + ". " + sentence("bb", rng, 80), sentence("cc", rng, 90), "  12 ", " ".join(["word"] * 5)]
    plain = {k: (lang, score, g) for k, lang, score, g in langid.label(texts, model)}
    for size in (20, 100):
        for k, lang, score, g in langid.label(texts, model, size):
            assert lang == plain[k][0] and score == pytest.approx(plain[k][1], abs=1e-5) and np.allclose(g, plain[k][2], atol=1e-5)
