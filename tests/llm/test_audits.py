"""Filter audit, spelling variants and decontamination against brute-force versions, with odd rows."""

import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, filter_audit, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang]); extra adds columns whose names the operators use themselves."""
    df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "a", None) for r in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("part", "digest", "first", "A", "E", "quality", "toxic", "word", "n", "size", "mask", "key", "own", "items", "item", "window", "n_hit", "id", "labels")}) if extra else df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_audit(rows, marks):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > first[t],
        }
        facts.append((lang or "", fails, *(i is not None and any(m[0] == i and m[k] == 1 for m in marks) for k in (1, 2))))
    out, removed_by = set(), Counter()
    rowset = []
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                stay = [f for f in left if not f[1][letter]]
                redundant = sum(f[1][letter] for f in own) - len(gone)
                unique = sum(f[1][letter] and sum(f[1].values()) == 1 for f in own)
                removed_by[part, letter] += len(gone)
                rowset.append((part, order, step, len(stay), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone)))
                left = stay
    for r in rowset:
        out.add((*r, removed_by[r[0], r[1][r[2] - 1]]))
    return out


LONG = " ".join(f"word{i}" for i in range(220))
AUDIT = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (4, LONG + " #", "en"), (5, "SHOUT " * 250, "en"), (6, None, "en"), (7, "", "de"), (8, " \n\t", "de"), (None, LONG, "en"), (None, None, ""),
    (9, "é" * 100 + "ABCDE", "en"), (9, LONG, "en"), (10, "x " * 30_000, "fr"), (11, "x " * 30_000, "fr"), (12, LONG.upper() + "|", "en"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (6, None, None), (7, 1, None), (7, 0, 1), (9, 1, 0), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("extra", [False, True])
def test_audit_matches_brute_force(spark, extra):
    found = [tuple(r) for r in filter_audit.audited(docs(spark, AUDIT, extra), labels(spark, MARKS)).collect()]
    assert set(found) == brute_audit(AUDIT, MARKS) and len(found) == 600 * 4


def test_audit_blocks_and_partitions_are_summed(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(150 + i % 90)) + ("$" if i % 3 else ""), f"l{i % 11}") for i in range(400)]
    flags = filter_audit.document_flags(docs(spark, rows), labels(spark, MARKS)).repartition(5)
    whole = {tuple(r) for r in filter_audit.audit(filter_audit.subset_counts(filter_audit.bitmap_index(flags))).collect()}
    monkeypatch.setattr(filter_audit, "BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        index = filter_audit.bitmap_index(flags)
        assert index.count() >= 400 / 13
        assert {tuple(r) for r in filter_audit.audit(filter_audit.subset_counts(index)).collect()} == whole == brute_audit(rows, MARKS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audited(docs(spark, []), labels(spark, [])).count() == 0
    assert filter_audit.audited(docs(spark, [(1, None)]), labels(spark, [])).count() == 600


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def brute_variants(rows, every=31):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelling_rows():
    base = ["committee", "commitees", "comittee", "committe", "übermäßig", "übermässig", "separate", "seperate", "élection", "selection", "aaaaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa"]
    text = lambda i: " ".join(w.upper() if i % 5 == 0 and w.isascii() else w for k, w in enumerate(base) for _ in range(1 + (i * (k + 3)) % 7))
    rows = [(i, text(i)) for i in range(60)] + [(1000 + i, "representation " * 120 + "representatio " * (10 if i < 1 else 0) + "reprsentatio " * (2 if i < 1 else 0)) for i in range(3)]
    return rows + [(None, "committee's committee"), (None, None), (70, ""), (70, "née×÷née coördinate coördinate 漢字committee_committeé"), (71, "y" * 20_000 + " " + "z" * 40)]


@pytest.mark.parametrize("extra,every", [(False, 31), (True, 3)])
def test_variants_match_brute_force(spark, extra, every):
    rows = spelling_rows()
    assert {tuple(r) for r in spelling.variants(docs(spark, rows, extra), every=every).collect()} == brute_variants(rows, every)


def test_variants_follow_chains_and_break_ties(spark):
    rows = [(1, "abcdefgh " * 2 + "abcdefghi " * 20 + "abcdefgha " * 20 + "abcdefghai " * 300 + "abcdefghaii " * 3000)]
    found = {r.word: r for r in spelling.variants(docs(spark, rows), every=1 << 40).collect()}
    assert found["abcdefgh"].form == "abcdefgha" and found["abcdefgh"].root == "abcdefghaii" and found["abcdefgh"].n_near == 2
    assert found["abcdefghi"].form == "abcdefghai" and found["abcdefghaii"].form is None and found["abcdefghaii"].root == "abcdefghaii"
    assert spelling.variants(docs(spark, [])).count() == 0 and spelling.variants(docs(spark, [(1, None), (2, "short")])).count() == 0


def test_words_meet_in_few_pairs(spark):
    """Every near pair once, whatever bands and halves the words share."""
    words = [f"{a}{b}{c}tion{d}" for a in "abc" for b in "xyz" for c in "mno" for d in ("", "s")]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = sorted((r.a, r.b) for r in spelling.near_pairs(frame).collect())
    letters = sorted(set("".join(words)))
    assert pairs == sorted({(w, x) for w in words for x in edits(w, letters) if w < x and x in set(words)})


def brute_leaks(rows, items, width=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, seen = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    seen |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in seen if x is not None)))
    return sorted(out, key=str)


ITEMS = [(1, "What is the capital of the country that lies North-West of Spain and Portugal?"), (2, "short one"), (20, "Été à la plage"), (3, "x"), (4, None), (5, " ?! "), (None, "no id here at all"), (2, "another text of the same id"), (6, "short one")]
QUESTION = ITEMS[0][1]
TEXTS = [
    (1, f"Intro. {QUESTION.upper()} And more."), (2, "the capital of the country that lies north west of"), (3, "capital of the country that lies north west of Spain... and"), (4, "SHORT\n\none short one"), (5, "été À la plage; ÉTÉ à la plage"),
    (6, None), (7, ""), (8, " .. "), (None, "no  ID here, at all"), (9, "x"), (9, "xx y"), (10, f"{QUESTION} " * 300), (11, "日本 x 語"), (12, "short" + " one" * 3), (13, "nothing at all"), (None, "no  ID here, at all"),
]


@pytest.mark.parametrize("extra,most", [(False, 100_000), (True, 100_000), (False, 3), (True, 1)])
def test_leaks_match_brute_force(spark, extra, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bench = bench.withColumns({c: F.lit(1) for c in ("items", "item", "words", "window")}) if extra else bench
    found = decontamination.found(docs(spark, TEXTS, extra), bench, most=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str) == brute_leaks(TEXTS, ITEMS)
    texts = {i: t for i, t in TEXTS}
    for r in found:
        assert r.n_hit == sum(s.last - s.first + 1 for s in r.spans)
    spans = {r.doc_id: [texts[r.doc_id][s.begin : s.end] for s in r.spans] for r in found if r.doc_id in (1, 4, 11)}
    assert spans == {1: [QUESTION.upper()[:-1]], 4: ["SHORT\n\none short one"], 11: ["x"]}


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.found(docs(spark, []), bench).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontamination.found(docs(spark, [(1, "short one")]), bench.where("false")).collect()] == [(2, 0, [])]
