"""Texts longer than the pieces in which the operators work on them give what plain versions give."""

import hashlib
import re

from pyspark.sql import functions as F
from test_operators import BASE, LABELS, brute_lines, brute_near, docs

from tidewatch.llm import exact_dedup, language_id, line_dedup, near_dedup, quality_model, quality_rules, toxicity

LONG = " ".join(f"long{k * 7919 % 60013}" for k in range(70_000))  # about 650,000 bytes, over 2^16 words


def test_near_copies_of_long_texts(spark):
    words = LONG.split(" ")
    close, far = words[:], words[:]
    close[::60], far[::16] = ["edit"] * len(words[::60]), ["edit"] * len(words[::16])
    rows = [(1, LONG), (2, " ".join(close)), (3, " ".join(far)), (4, LONG.upper()), (5, "tail " + LONG), (6, BASE), (7, BASE + " tail")]
    found = {tuple(r) for r in near_dedup.near_classes(docs(spark, rows), 4, 80).collect()}
    assert found == brute_near(rows, 4, 80)


def test_lines_and_copies_of_long_texts(spark):
    common = "c" * 100_000
    rows = [(i, f"{LONG[i:]}\n{common}\nown {i}") for i in range(6)] + [(10, "x\n" * 60_000 + common)]
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()} == brute_lines(rows)
    rows = [(1, LONG), (2, LONG.replace(" ", "\n\t")), (3, LONG + "!"), (4, LONG + " !")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {tuple(r) for r in exact_dedup.classes(docs(spark, rows)).collect()} == {(1, 1, 2, True, sha(LONG)), (2, 1, 2, False, sha(LONG)), (3, 3, 1, True, sha(LONG + "!")), (4, 4, 1, True, sha(LONG + " !"))}


def test_quality_figures_of_long_texts(spark):
    words = re.findall("[^\x20\x09-\x0d]+", LONG)
    seen, repeated = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {k + j for k in places for j in range(3)}
    row = quality_rules.measured(docs(spark, [(1, LONG), (2, "# \n" * 50_000)])).where("doc_id = 1").first()
    assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (len(words), sum(map(len, words)), len(repeated), 0)


def test_scores_of_long_texts(spark):
    model = toxicity.Model()
    rows = toxicity.scored(docs(spark, [(1, LONG), (2, LONG + ". you idiot"), (3, "")]), model).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1] == scores[3] != scores[2]

    good = lambda i, n: " ".join(f"Word{(i + k) % 5} and other{k % 15} things." for k in range(n))
    bad = lambda i, n: " ".join(f"WORD{(i + k) % 15}!! %%%" for k in range(n))
    learned = [(i, good(i, 15) if i % 2 else bad(i, 15)) for i in range(160)]
    df = docs(spark, [*learned, (500, good(0, 40_000)), (501, bad(0, 40_000))])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], LABELS)
    scores = {r.doc_id: r.score for r in quality_model.scored(df, quality_model.fit(df, labels)).where("doc_id >= 500").collect()}
    assert scores[500] >= 0.5 > scores[501]


def test_language_of_long_texts(spark):
    text = {"en": "the quick brown fox and the lazy dog went to the river with their friends", "de": "der schnelle braune fuchs und der faule hund gingen mit ihren freunden zum fluss"}
    rows = [(i, " ".join(w for k, w in enumerate(text[lang].split()) if (i + k) % 5), lang) for i in range(80) for lang in [("en", "de")[i % 2]]]
    rows += [(500 + k, (text[lang] + " ") * 16_000, None) for k, lang in enumerate(("en", "de"))]
    df = docs(spark, rows)
    found = {r.doc_id: r.lang_pred for r in language_id.predicted(df, language_id.fit(df)).where(F.col("doc_id") >= 500).collect()}
    assert len(rows[-1][1]) > language_id.CHUNK and found == {500: "en", 501: "de"}
