"""Language identification against a plain naive Bayes, with more languages than one pass takes."""

import collections
import math
import random

import pytest

from factspan.llm import language_id


def grams(text):
    """Hashed columns of a text's character n-grams, by the stated hash; what is no letter counts as a blank."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    for n in language_id.GRAMS:
        for i in range(len(codes) - n + 1):
            if n > 1 and codes[i] == 32 and codes[i + n - 1] == 32 or n == 1 and codes[i] == 32:
                continue
            h = n
            for c in codes[i : i + n]:
                h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            yield h % language_id.COLUMNS


def plain(train, texts):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
            total[lang] += 1
    out = []
    for text in texts:
        if not total or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in total:
            size = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.COLUMNS
            logs[lang] = math.log(total[lang] / sum(total.values())) + sum(math.log((counts[lang][g] + language_id.SMOOTHING) / size) for g in grams(text))
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


@pytest.mark.parametrize("each", [2, 256])
def test_as_plain_naive_bayes(spark, monkeypatch, each):
    monkeypatch.setattr(language_id, "LANGUAGES_EACH", each)
    draw = random.Random(3)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghiéüß", "dd": "abcxyz", "ee": "ñopqrs"}
    make = lambda lang, n: " ".join("".join(draw.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    train = [(make(lang, 6), lang) for lang in letters for _ in range(8)] + [(None, "aa"), ("abc", None), ("", "bb"), ("12 !", "cc")]
    texts = [make(lang, 2) for lang in letters for _ in range(4)] + [None, "", "1!", "a", "zzz qqq", make("aa", 4000)]
    texts += texts[:2]
    model = language_id.train(spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string, best string").repartition(3))
    table = spark.createDataFrame([(i if i % 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, top string").repartition(2)
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in language_id.identify(table, model).collect())
    assert got == sorted((str(i if i % 3 else None), lang, round(score, 3)) for i, (lang, score) in enumerate(plain(train, texts)))


def test_more_than_a_thousand_languages(spark):
    rows = [(i, chr(0x4E00 + i) * 4, f"l{i:04}") for i in range(1001)]
    rows += [(2000 + i, text, lang) for i, text, lang in rows[:900]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = language_id.train(table)
    assert len(model.names) == 1001
    rare = table.filter("doc_id between 900 and 1000")
    truth = {i: lang for i, _, lang in rows}
    got = language_id.identify(rare, model).collect()
    assert len(got) == 101 and all(r["lang_pred"] == truth[r["doc_id"]] for r in got)
