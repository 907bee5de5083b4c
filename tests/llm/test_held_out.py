"""The learned operators on documents of their held-out folds, and their scores against plain versions, one text at a time."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import language_id, quality_model, queries, toxicity
from tidewatch.llm.common import read

TABLES, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def area(pairs):
    """Chance that a document of label 1 scores above one of label 0; ties count half."""
    ones, zeros = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def held_out(found, truth, column):
    rows = found.where("held_out").join(truth, "doc_id").where(F.col(column).isNotNull()).select("score", "predicted", column).collect()
    return [(r["score"], r[column]) for r in rows], sum(r["predicted"] == r[column] for r in rows) / len(rows), max(sum(r[column] == k for r in rows) for k in (0, 1)) / len(rows)


def test_held_out_toxicity(spark):
    pairs, right, majority = held_out(queries.op3_toxicity(spark, LARGER), read(spark, LARGER, "labels"), "toxic")
    assert area(pairs) > 0.96 and right > majority + 0.75 * (1 - majority)


def test_held_out_quality(spark):
    pairs, right, majority = held_out(queries.op7_quality_model(spark, LARGER), read(spark, LARGER, "labels"), "quality")
    assert area(pairs) > 0.99 and right > majority + 0.9 * (1 - majority)


def test_held_out_languages(spark):
    langs = read(spark, TABLES, "documents").select("doc_id", "lang").where("lang is not null")
    found = queries.op10_language_id(spark, TABLES).where("held_out").join(langs, "doc_id").collect()
    for lang in {r.lang for r in found}:
        own = [r for r in found if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) / len(own) > 0.93, lang


def texts_of(spark):
    return [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(60).collect()] + [None, "", "!!", "x" * 3000]


def plain_toxicity(text, model):
    """Clause by clause with a variable for each thing that the machines keep in mind."""
    table, clauses = model.lookup(), []
    for line in (text or "").lower().split("\n"):
        clause = []
        for raw in [*line.split(), None]:
            if raw is not None:
                word = raw.strip(toxicity.EDGE)
                label, weight = table.get(word) or max(((toxicity.INSULT, w) for p, w in model.prefixes.items() if word.startswith(p)), key=lambda x: x[1], default=(toxicity.OTHER, 0.0))
                if raw[0] in "“«\"" and label == toxicity.OTHER:
                    label = toxicity.REPORT
                clause.append((label, weight))
            if raw is None or raw.endswith(toxicity.BREAKS):
                score, negated, reported, seen = 0.0, 0, False, set()
                for i, (label, weight) in enumerate(clause):
                    attack = label in (toxicity.INSULT, toxicity.THREAT)
                    if attack:
                        before, behind = (any(x == toxicity.TARGET for x, _ in part) for part in (clause[:i], clause[i + 1 :]))
                        aim = 1.3 if before or behind else 0.4 if label == toxicity.THREAT else 1.0
                        kind = (1.2 if label in seen else 1.0) if not negated else (0.6 if label in seen else 0.5)
                        score += weight * aim * (0.6 if reported else 1.0) * kind
                        seen.add(label)
                    negated = 3 if label == toxicity.NEGATION else max(0, negated - 1)
                    reported = reported or label == toxicity.REPORT
                if score:
                    clauses.append(score)
                clause = []
    features = [math.log1p(sum(clauses)), max(clauses, default=0.0), math.log1p(len(clauses))]
    return 1 / (1 + math.exp(-(model.layer[0] + sum(w * f for w, f in zip(model.layer[1:], features)))))


def test_toxicity_scores_against_a_plain_walk(spark):
    docs, labels = read(spark, TABLES, "documents"), read(spark, TABLES, "labels")
    model = toxicity.fit(docs, labels)
    texts = texts_of(spark) + ["you idiot, you. i will kill you and not hurt them", "“stupid” he said you stupid stupid", "no never stupid you kill kill", "kill", "idiot you", *[r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]]
    found = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(abs(found[i] - plain_toxicity(t, model)) < 1e-9 for i, t in enumerate(texts)) and max(found.values()) > 0.9


def test_quality_scores_against_a_plain_walk(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = quality_model.fit(docs, read(spark, "/root/testdata/sf0.001", "labels"))

    def plain(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        shape = lambda w: bytes(ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in w)
        place = lambda w: zlib.crc32(w) % quality_model.BUCKETS
        mean = lambda ws: sum((model.vectors[place(w)].astype(float) for w in ws), np.zeros(quality_model.WIDTH)) / max(1, len(ws))
        own, shapes = mean(words), mean([shape(w) for w in words])
        n = len(words)
        lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
        pairs = sum(place(a) == place(b) for k, (a, b) in enumerate(zip(words, words[1:]), 1) if k % quality_model.CHUNK)
        x = [*own, *shapes, *([math.sqrt(own @ own), math.sqrt(shapes @ shapes), math.log1p(n) / 10, pairs / n, len(set(map(place, words))) / min(n, quality_model.BUCKETS), 1 - len(set(lines)) / max(1, len(lines)), min(2.0, sum(map(len, words)) / n / 10)] if n else [0] * 7)]
        z = [max(-6, min(6, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        w1, b1, w2, b2 = model.layers
        hidden = [math.tanh(sum(a * w for a, w in zip(z, w1[:, j])) + b1[j]) for j in range(len(b1))]
        return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / model.temperature))

    texts = texts_of(spark)
    found = {r.doc_id: r.score for r in quality_model.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(abs(found[i] - plain(t)) < 1e-4 for i, t in enumerate(texts))


def test_languages_against_plain_cosines(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs)

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        words = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
        data, grams = words.encode(), {}
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                value = 0
                for b in data[i : i + n]:
                    value = value * 257 + b
                at = ((value * 2654435761 + (n - 1) * 40503) % (1 << 32)) >> 20
                grams[at] = grams.get(at, 0) + 1
        v = {at: math.log1p(k) * model.idf[at] for at, k in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * c[at] for at, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
        return model.languages[best], cosines[best]

    texts = [t[:2_000] if t else t for t in texts_of(spark)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        lang, score = plain(t)
        assert found[i][0] == lang and abs(found[i][1] - score) < 1e-6, t
