"""The toxicity model against one that names its n-grams."""

import math
import random
import zlib

import numpy as np

from listaro.llm import toxicity


def grams(text):
    padded = f" {' '.join(text.lower().split())} " if text.split() else ""
    return {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}


def slot(gram):
    code, full = 0, (1 << 64) - 1
    for c in gram:
        code = (code * 0x9E3779B97F4A7C15 + ord(c) + 1) & full
    return (((code ^ (code >> 31)) * 0xBF58476D1CE4E5B9) & full) >> (64 - toxicity.BITS)


def texts():
    r = random.Random(5)
    plain, foul = "stone river cloud meadow lantern harbour signal winter garden copper".split(), "grobian lumpen schuft".split()
    return [(" ".join(r.choice(plain) for _ in range(20)) + (f" {r.choice(foul)} {r.choice(foul)}é" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]


def test_slots_are_those_of_the_named_ngrams():
    for text in ["", "  ", "a", "abc", "Ünï  çode\t日本 👍👍", *[t for t, _ in texts()[:10]]]:
        assert toxicity.ngram_slots(text).tolist() == sorted({slot(g) for g in grams(text)})


def test_ratios_choose_the_features_and_the_score_is_their_sum():
    rows = texts()
    model = toxicity.fit([toxicity.ngram_slots(t) for t, _ in rows], np.array([y for _, y in rows]))
    toxic, clean = [grams(t) for t, y in rows if y], [grams(t) for t, y in rows if not y]
    used = {}
    for g in set().union(*toxic, *clean):
        p, q = sum(g in x for x in toxic), sum(g in x for x in clean)
        ratio = math.log((p + 1) / (len(toxic) + 2)) - math.log((q + 1) / (len(clean) + 2))
        if p + q >= toxicity.LEAST_DOCS and abs(ratio) >= toxicity.LEAST_RATIO:
            used[g] = ratio
    assert {slot(g) for g in used} == set(np.flatnonzero(model["weight"]).tolist()) and any("grob" in g for g in used)
    # What only toxic texts have counts towards toxic.
    assert all(model["weight"][slot(g)] > 0 for g, ratio in used.items() if ratio > 2)
    for text in ["", "stone river", "grobian schufté", *[t for t, _ in rows[:6]]]:
        z = sum(float(model["weight"][slot(g)]) for g in grams(text)) + model["bias"]
        assert abs(toxicity.score(model, text) - 1 / (1 + math.exp(-z))) < 1e-4
    assert toxicity.score(model, "grobian schuft lumpen") > 0.5 > toxicity.score(model, "stone river cloud meadow")


def test_training_brings_the_features_alone_to_the_driver(spark, monkeypatch):
    rows, sizes, fit = texts(), [], toxicity.fit_places

    def seen(found, labels, slots, *rest):
        sizes.append((sum(map(len, found)), len(slots)))
        return fit(found, labels, slots, *rest)

    monkeypatch.setattr(toxicity, "fit_places", seen)
    known = [(i, t, y) for i, (t, y) in enumerate(rows) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    slots = [toxicity.ngram_slots(t) for _, t, _ in known]
    want = toxicity.fit(slots, np.array([y for *_, y in known]))
    assert np.allclose(model["weight"], want["weight"], atol=1e-5) and abs(model["bias"] - want["bias"]) < 1e-6
    assert sizes[0] == sizes[1] and sizes[0][0] < sum(map(len, slots)) / 2
    assert sizes[0][1] == np.count_nonzero(want["weight"])
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none["weight"].any() and none["bias"] == 0.0
