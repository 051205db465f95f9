"""Operators without SQL against plain Python versions of their rules."""

import math
import random
import re

import numpy as np

from colinear.llm import langid, licenses, quality_model

DOCS = "doc_id long, text string, lang string, source string"
FILL = "river stone cloud garden winter music lamp bridge forest table".split()


def test_license_base_columns(spark):
    r = random.Random(3)
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    pieces = [*FILL, *phrases, "Under THE mit-License", "CC-BY-NC", "apache license, version 2.0", "mit", "license", "cc by", "é", "ñc by nc", "under\x00the\x7fmit license", "\n"]
    texts = [r.choice((" ", ", ", "\n")).join(r.choice(pieces) for _ in range(r.randrange(0, 40))) for _ in range(120)] + [None, "", "cc by nc by nc"]
    got = {x.doc_id: x for x in licenses.license_labels(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        x = got[i]
        assert (x.n_words, x.n_base, x.base_labels) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        assert (x.first_word, x.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1 and (x.score == 1 if places else True)


def test_language_decoding_by_loops(spark):
    r = random.Random(5)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    text = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 7))) for _ in range(n))
    train = [(i, text(lang, 30), lang, "s") for i in range(20) for lang in letters]
    model = langid.fit(langid.sample_counts(spark.createDataFrame(train, DOCS).select("doc_id", "text", "lang")))
    cases = [(i, text(r.choice(list(letters)), r.randrange(1, 12)) + r.choice(("", " dg", " É!")), None, "s") for i in range(40)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(cases, DOCS), model).collect()}
    for i, t, *_ in cases:
        data = b" " + t.lower().encode() + b" "
        ids = [int(langid.trigram_ids(np.frombuffer(data[k : k + 3], np.uint8))[0]) for k in range(len(data) - 2)]
        losses = []
        for k in range(len(model.langs)):
            total = 0.0
            for b in range(model.code.shape[1]):
                margin = sum(float(model.weights[x, b]) for x in ids) / len(ids)
                total += math.log1p(math.exp(-model.code[k, b] * model.slope[b] * margin)) * model.worth[b]
            losses.append(total)
        shares = [math.exp(min(losses) - x) for x in losses]
        best = shares.index(max(shares))
        assert got[i].lang_pred == model.langs[best] and abs(got[i].score - shares[best] / sum(shares)) < 1e-6
        assert got[i].ambiguous == (got[i].score < langid.SURE)


def test_grades_by_loops(spark):
    """Cumulative links: one score for a text, a tail for each threshold, the expected grade their sum."""
    r = random.Random(6)
    words = {0: ["vile", "awful"], 1: ["meh", "spam"], 2: ["fine", "clear"]}
    rows = [(i, " ".join(r.choice(words[i % 3] + FILL) for _ in range(30)), i % 3) for i in range(300)]
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality_model.fit(quality_model.sample_features(rated), 3)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    texts = [t for _, t, _ in rows[:20]] + ["", "vile vile vile", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in quality_model.score(df, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        s = sum(float(model.weights[k]) for k in quality_model.features(None if t is None else t.encode(), {}))
        tails = [1 / (1 + math.exp(-max(-30.0, min(30.0, s - x)))) for x in model.thresholds]
        assert abs(got[i].expected_grade - sum(tails)) < 1e-4 and abs(got[i].p_top - tails[-1]) < 1e-4
        assert got[i].kept == (got[i].p_top >= quality_model.KEEP)
    assert sum(got[i].kept == (rows[i][2] == 2) for i in range(20)) >= 18
