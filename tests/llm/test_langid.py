import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexmill.llm import langid

from .conftest import corpus, frame

STEMS = {"en": ["the", "of", "with", "thing", "ing", "tion"], "de": ["der", "und", "schaft", "ung", "keit", "ich"], "ja": ["東", "京", "日", "本", "語", "は"]}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice(["", ".", ", 12"]) for _ in range(n))


def test_held_out_accuracy_and_edges(spark, rng):
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(STEMS) * 40)]
    model = langid.fit(frame(spark, rows[:90]))
    assert model.langs == ["de", "en", "ja"]
    got = {r.doc_id: r for r in langid.predict(frame(spark, rows[90:] + [(d, t) for d, t in corpus(rng) if d is None]), model).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[90:])
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = [(1, None), (2, ""), (3, "12 !! 34"), (4, "Ж"), (5, "THE der the"), (6, text(rng, "de", 20_000))]
    odd = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.predict(frame(spark, odd), model).collect()}
    assert [odd[i] for i in (1, 2, 3)] == [("und", False)] * 3
    assert odd[4][0] in model.langs and odd[5][0] == "en" and odd[6] == ("de", True)


def test_nothing_learned(spark):
    model = langid.fit(frame(spark, [(1, "text", None), (2, None, "en")]))
    assert [(r.lang_pred, r.score) for r in langid.predict(frame(spark, [(1, "words")]), model).collect()] == [("und", 0.0)]
    assert langid.predict(frame(spark, []), model).count() == 0


def test_backoff_uses_the_longest_known_gram():
    import numpy as np

    words = pa.array(["abcd", "xbcy", "q"])
    code, owner = langid.gram_codes(words, 3)
    assert owner.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2]  # " ab", "abc", "bcd", "cd " ...
    assert [len(langid.gram_codes(words, n)[0]) for n in (1, 2, 4)] == [9, 12, 6]
    assert len(set(langid.word_codes(pa.array(["ab", "ba", "a", "東京"])).tolist())) == 4
    tables = {n: (np.sort(langid.gram_codes(pa.array(["abcd"]), n)[0]), np.zeros((len(langid.gram_codes(pa.array(["abcd"]), n)[0]), 1), np.float32) - n) for n in range(1, 5)}
    tables[0] = (np.zeros(0, np.uint64), np.zeros((0, 1), np.float32))
    model = langid.Model(["x"], np.zeros(1), tables)
    assert model.score_words(pa.array(["abcde", "xbcy", "zzb", "zz"])).ravel().tolist() == [-4.0, -2.0, -1.0, 0.0]


def test_bounds_of_the_model(spark, rng):
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(STEMS) * 20)]
    model = langid.fit(frame(spark, rows), max_words=5, max_grams=8)
    assert len(model.tables[0][0]) <= 15 and all(len(model.tables[n][0]) <= 24 for n in range(1, 5))


def plain(rows, texts):
    """Word-first backoff from its definition: log frequencies of known words, else the mean over known 4-grams, else 3-grams, and so on."""
    runs = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n) if n > 1 or f" {w} "[i] != " "]
    langs = sorted({lang for _, _, lang in rows})
    words = {lang: Counter(w for _, t, own in rows if own == lang for w in runs(t)) for lang in langs}
    tables = [words, *({lang: Counter(g for w in words[lang] for g in grams(w, n)) for lang in langs} for n in range(1, 5))]
    known = [set().union(*t.values()) for t in tables]
    log = lambda n, x, lang: math.log((tables[n][lang][x] + 0.5) / (sum(tables[n][lang].values()) + 0.5 * (len(tables[n][lang]) + 1)))
    out = []
    for t in texts:
        total = dict.fromkeys(langs, 0.0)
        for w in runs(t):
            if w in known[0]:
                parts, n = [w], 0
            else:
                parts, n = next((([g for g in grams(w, n) if g in known[n]], n) for n in range(4, 0, -1) if any(g in known[n] for g in grams(w, n))), ([], 0))
            for lang in langs:
                total[lang] += sum(log(n, g, lang) for g in parts) / max(1, len(parts))
        best = max(langs, key=lambda x: total[x]) if runs(t) else "und"
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values()) if runs(t) else 0.0))
    return out


def test_against_the_definition(spark, rng):
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["en", "de", "ja"] * 12)]
    texts = [text(rng, lang, 3) for lang in ["en", "de", "ja"] * 8] + ["zzz", "The unDUNG", "x tion", None, "123", "東は日 the", " ".join(text(rng, x, 1) for x in ("en", "de", "ja"))]
    got = {r.doc_id: r for r in langid.predict(frame(spark, list(enumerate(texts))), langid.fit(frame(spark, rows))).collect()}
    for i, (lang, score) in enumerate(plain(rows, texts)):
        assert got[i].score == pytest.approx(score, abs=1e-4)
        assert got[i].lang_pred == lang or score < 0.5001
