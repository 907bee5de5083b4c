"""Small cases and brute-force versions of the text-corpus operators."""

import gzip
import hashlib
import re
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, pieces, quality_model, quality_rules, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]); extra adds columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("norm", "h", "key", "size", "node", "component", "bucket", "__id", "target", "y", "n")}) if extra else df


BASE = " ".join(f"word{i}" for i in range(60))
ODD = [(1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", "b"), (None, "text without an id", "en", "b"), (4, BASE), (4, BASE), (5, BASE + " tail"), (6, "é" * 3000, "fr", None), (7, "a\n" * 500, "en", "c")]


@pytest.mark.parametrize("extra", [False, True])
def test_exact_classes(spark, extra):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(docs(spark, [*ODD, (9, BASE.replace(" ", "\n ")), (8, BASE + " ")], extra)).collect()}
    assert (9, 4, 3, False) in rows and (4, 4, 3, True) in rows and (8, 8, 1, True) in rows
    assert (1, 1, 2, True) in rows and (2, 1, 2, False) in rows and (3, 3, 1, True) in rows
    assert exact_dedup.classes(docs(spark, [])).count() == 0


def test_exact_collisions_are_told_apart_by_bytes(spark):
    weak = lambda norm: F.length(norm).cast("string").cast("binary")
    rows = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.classes(docs(spark, [(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd"), (5, "xyz")]), weak).collect()}
    assert rows == {(1, 1, 2), (3, 1, 2), (2, 2, 2), (4, 2, 2), (5, 5, 1)}


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_exact_classes_do_not_depend_on_the_map_of_repeated_hashes(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    rows = [(i, f"text {i % 300}") for i in range(500)] + [(None, "text 7"), (None, "alone"), (600, None)]
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    expected = sorted((str(i), str(keep[t or ""]), len(texts[t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.classes(docs(spark, rows)).collect()) == expected
    kept = sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_copies(docs(spark, rows)).collect())
    assert kept == sorted((str(keep[t]), t) for t in texts)


def test_drop_copies_keeps_columns(spark):
    df = docs(spark, ODD, True)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7]
    odd = docs(spark, [(5, "a"), (5, "b"), (3, "b"), (None, "c"), (None, "d"), (None, "a"), (None, "c")])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(odd).collect()) == [(0, "c"), (0, "d"), (3, "b"), (5, "a")]


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = set()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.add((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup(spark, extra):
    long, other = "The Same Licence line in many documents, word for word", "É" * 41
    rows = [(i, f"own {i}\n \t{long.upper() if i % 2 else long}\x0c\n{other if i < 4 else other.lower()}\n\nshort") for i in range(8)] + [(20, None), (21, ""), (22, "x\n")]
    found = {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, rows, extra)).collect()}
    assert found == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_line_runs_compact_split_batches_and_reopen(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    text = lambda i: "\n".join(f"line number {k} that is long enough to be a key" for k in range(i, i + 3))
    for i in range(5):
        batch = line_dedup.hashed_lines(docs(spark, [(i, text(i))]), 40)
        fresh = runs.split(batch).groupBy("new").count().collect()
        assert {r["new"]: r["count"] for r in fresh} == ({True: 3} if i == 0 else {True: 1, False: 2})
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    found = {(r.n_docs, r.holder) for r in runs.counts().collect()}
    assert found == {(1, 0), (2, 1), (3, 2), (3, 3), (3, 4), (2, 4), (1, 4)} and runs.rows().where("new").count() == 7
    for path in runs.levels[0] + runs.levels[2]:
        spark.sql(f"drop table {runs._table(path)}")
    again = line_dedup.LineRuns.open(spark, runs.root)
    again.add(line_dedup.hashed_lines(docs(spark, [(9, text(0))]), 40))
    assert [len(x) for x in again.levels] == [0, 1, 1] and max(r.n_docs for r in again.counts().collect()) == 4
    plan = again.rows().groupBy("h1", "h2").agg(F.sum("n_docs"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_line_dedup_needs_the_anti_join(spark, monkeypatch):
    rows = [(i, "this line is in all of the documents, word for word") for i in range(40)]
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, rows), min_docs=30).collect()} == brute_lines(rows, min_docs=30)
    monkeypatch.setattr(line_dedup.LineRuns, "split", lambda self, own: own.withColumn("new", F.lit(True)))
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, rows), min_docs=30).collect()} != brute_lines(rows, min_docs=30)


def test_line_dedup_goes_on_with_a_root(spark, tmp_path):
    shared, other = "this line is in all of the documents, word for word", "and this one in the last four documents of the six"
    rows = [(i, f"own {i}\n{shared}\n" + (other if i > 2 else "x")) for i in (5, 2, 6, 1, 4, 3)]
    root = str(tmp_path / "runs")
    call = lambda part: {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, part), min_docs=4, batches=2, root=root).collect()}
    assert call(rows[:3]) == brute_lines(rows[:3], min_docs=4)
    assert call(rows[3:]) == {r for r in brute_lines(rows, min_docs=4) if r[0] in (1, 3, 4)}
    counts = sorted((r.n_docs, r.holder) for r in line_dedup.LineRuns.open(spark, root).counts().collect())
    assert counts == [(4, 6), (6, 6)]


def test_line_dedup_of_a_text_of_many_lost_lines(spark):
    lines = [f"line {k} that is long enough to be a key of the runs" for k in range(3000)]
    rows = [(i, "\n".join(lines) + f"\nown {i}") for i in range(5)] + [(2, "\n".join(lines[:50] + ["again"])), (2, "\n".join(lines[:50] + ["again"]))]
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()} == brute_lines(rows)


def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((part[a], part[b]))
                part = {k: x if v == y else v for k, v in part.items()}
    return {(i, len(sets[i]), part[i], part[i] == i) for i in sets}


def near_rows():
    """Chains of edits around bases, a passage that all share, copies and short texts."""
    import random

    rng, rows, n = random.Random(5), [], 0
    passage = [f"p{k}" for k in range(30)]
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(90)]
        for _ in range(25):
            copy = words[:]
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(90)] = f"e{rng.randrange(40)}"
            rows.append((n := n + 1, " ".join(copy + (passage if base else []))))
    rows += [(100 + k, " ".join([f"own{k}x{j}" for j in range(8)] + passage)) for k in range(30)]
    return rows + [(200, None), (201, ""), (202, "One two"), (203, "one  TWO"), (204, "three"), (205, rows[0][1].upper()), (206, " ")]


@pytest.mark.parametrize("width,extra", [(4, False), (5, True)])
def test_near_classes_match_brute_force(spark, width, extra):
    rows = near_rows()
    found = {tuple(r) for r in near_dedup.near_classes(docs(spark, rows, extra), width, 80).collect()}
    assert found == brute_near(rows, width, 80)


@pytest.mark.parametrize("block", [3, 10_000])
def test_near_chains_are_compared_by_shingle_or_as_one(spark, monkeypatch, block):
    """A long chain of windows, each near some of its neighbours only, whose shingles are held by a few of them."""
    import random

    rng, at, rows = random.Random(9), 0, []
    for n in range(1, 90):
        rows.append((n, " ".join(f"c{k}" for k in range(at, at + 72))))
        at += rng.choice((5, 9, 12))
    rows += [(n + 1000, t) for n, t in near_rows()]
    seen, units = [], near_dedup._units
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "_units", lambda met: seen.append(units(met)) or seen[-1])
    assert {tuple(r) for r in near_dedup.near_classes(docs(spark, rows), 4, 80).collect()} == brute_near(rows, 4, 80)
    single = sum(u.where("unit <> cluster").count() for _, u in seen)
    assert single > 0 if block == 3 else seen and single == 0


def test_turns_of_leaders_leave_less_of_a_close_group_for_blocks(spark, monkeypatch):
    """Texts about as similar as the threshold: the classes are the same with any number of turns."""
    import random

    rng, rows = random.Random(2), []
    for n in range(150):
        words = [f"w{k}" for k in range(240)]
        for _ in range(4):
            words[rng.randrange(240)] = f"x{rng.randrange(10**9)}"
        rows.append((n, " ".join(words)))
    expected, seen, units = brute_near(rows, 4, 80), [], near_dedup._units
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "_units", lambda met: seen.append(met.select("doc_id").distinct().count()) or units(met))
    assert {tuple(r) for r in near_dedup.near_classes(docs(spark, rows), 4, 80).collect()} == expected
    once = sum(seen)
    seen.clear()
    assert {tuple(r) for r in near_dedup.near_classes(docs(spark, rows), 4, 80, turns=8).collect()} == expected
    assert sum(seen) < once


def test_near_edges(spark):
    assert near_dedup.near_classes(docs(spark, [])).count() == 0
    kept = near_dedup.drop_near_copies(docs(spark, ODD, True))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 2, 3, 4, 4, 6, 7]
    assert kept.where("doc_id is null").count() == 1


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 50), (50, 60), (7, 7)], "a long, b long")
    found = {tuple(r) for r in near_dedup.connected_components(edges).collect()}
    assert found == {(i, 1) for i in range(1, 31)} | {(40, 40), (50, 40), (60, 40)}


@pytest.mark.parametrize("extra", [False, True])
def test_mixing(spark, extra):
    rows = [(i, "w " * (5 + i * 7 % 90), "en", f"s{i % 4}" if i % 9 else None) for i in range(300)] + [(900, None), (901, "", "en", None)]
    df = docs(spark, rows, extra)
    first, again = (sorted(tuple(r) for r in mixing.mix(x, block=64).collect()) for x in (df, df.repartition(5)))
    assert first == again and len(first) == 302
    source = {r[0]: r[3] if len(r) > 3 else "a" for r in rows}
    per = {}
    for i, size, source_size, target, taken, *_ in first:
        assert 0 <= taken <= 2 * size
        x = per.setdefault(source[i], [0, source_size, target, 0])
        x[0] += size
        x[3] += taken
    for size, source_size, target, taken in per.values():
        assert size == source_size and abs(taken - target) <= 1 and target <= 2 * size + 1e-9
    assert abs(sum(x[2] for x in per.values()) - 1.5 * sum(x[0] for x in per.values())) < 1e-6
    order = sorted([s for s in per if s is not None]) + [None]
    free = [per[s][2] / (5, 2, 1)[k % 3] for k, s in enumerate(order) if per[s][2] < 2 * per[s][1] - 1e-9]
    assert max(free) - min(free) < 1e-6
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None)])).first().taken == 0
    plain = lambda i, bits: i
    other = {r.doc_id: r.slot for r in mixing.mix(df, block=64, point=plain).collect()}
    assert sum(r[-1] != other[r[0]] for r in first if r[0] is not None) > 100
    mixed = mixing.mixed_documents(df, block=64)
    assert mixed.columns == df.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_schedule_spreads_each_source_evenly(spark):
    points = [r[0] for r in spark.range(64).select(mixing.van_der_corput(F.col("id"), 6)).collect()]
    assert points == [int(f"{i:06b}"[::-1], 2) for i in range(64)]
    sources = spark.createDataFrame([("=a", "a", 40_000, 60_000.0), ("=b", "b", 9_000, 18_000.0), ("=c", "c", 7, 3.0), ("", None, 0, 0.0)], "key string, source string, source_size long, target double")
    slots = mixing.schedule(sources, 100).orderBy("slot").collect()
    words = {}
    for i, r in enumerate(slots):
        words[r.key] = words.get(r.key, 0) + r.used
        if i > 100:  # at any time a source has had its share of the words so far, but for a few blocks
            assert abs(words.get("=b", 0) - sum(words.values()) * 18 / 78) < 1_000
    assert words == {"=a": 60_000, "=b": 18_000, "=c": 3}
    assert [r.rank for r in slots if r.key == "=b"] == list(range(180)) and len({r.slot for r in slots}) == len(slots)


def test_mixture_has_its_slots(spark):
    df = docs(spark, [(i, f"w{i} " * 40, "en", f"s{i % 3}") for i in range(200)]).withColumn("place", F.lit(1))
    digest = F.unhex(F.sha2(F.concat(F.sha2(mixing._key(F.col("source")), 256), "text"), 256))
    at = {r.doc_id: {x for x in (r.first_slot, r.second_slot) if x is not None} for r in mixing.mix(df.withColumn("digest", digest), block=64, carry=("digest",)).collect()}
    mixed = mixing.mixed_documents(df, slot="at", block=64)
    assert mixed.columns == [*df.columns, "at"]
    seen = {}
    for r in mixed.collect():
        seen.setdefault(r.doc_id, []).append(r["at"])
    assert len(seen) > 100 and all(len(set(x)) == len(x) and set(x) <= at[i] for i, x in seen.items())


def test_points_and_products_of_long_schedules(spark):
    i, bits, total = (1 << 40) - 12_345, 41, (1 << 41) - 7
    r = spark.range(1).select(mixing.van_der_corput(F.lit(i), bits).alias("p"), mixing.scaled(mixing.van_der_corput(F.lit(i), bits), total, bits).alias("u")).first()
    point = int(f"{i:041b}"[::-1], 2)
    assert (r.p, r.u) == (point, point * total >> bits)
    for bits, total in ((1, 2), (6, 50), (20, (1 << 20) - 3), (25, 30_000_001)):
        rows = spark.range(0, 1 << bits, max(1, (1 << bits) // 50)).select("id", mixing.scaled(F.col("id"), total, bits).alias("u")).collect()
        assert all(x.u == x.id * total >> bits for x in rows)
    huge = spark.createDataFrame([("=a", "a", 1 << 62, float(1 << 62))], "key string, source string, source_size long, target double")
    with pytest.raises(ValueError):
        mixing.schedule(huge, 1024)


def test_rows_that_are_alike_are_dealt_over_the_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 16)
    df = docs(spark, [(7, "some words here", "en", "a")] * 300 + [(None, "x y", "en", "a")] * 100 + [(1, "one", "en", "b")])
    sized = df.select("doc_id", "source", mixing._key(F.col("source")).alias("key"), mixing.n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))
    placed = mixing.placed_documents(sized, mixing.targets(sized)).orderBy("key", "start").collect()
    ends = [r.start + r.size for r in placed]
    assert len(placed) == 401 and [r.start for r in placed] == [0, *ends[:399], 0] and ends[399] == 1100
    mixed = mixing.mix(df, block=64).collect()
    assert sum(r.taken for r in mixed) == round(1.5 * 1101) and len({r.taken for r in mixed if r.doc_id == 7}) > 1


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


TEXTS = ["", " ", "  two  blanks ", "line\n\nbreaks\r\n", "▁ marker ▁▁x", "日本語 テキスト", "emoji 😀\x00\t", "a" * 3000, "mixed Überraschung não " * 20]


def encoded_texts(encoder, texts):
    """Ids of each text, straight from the encoder."""
    import numpy as np

    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    full, blanked, begins = pieces._with_blanks(data, np.cumsum([0, *map(len, raw)])[:-1])
    flat, edges, fine = pieces._checked(encoder, blanked, begins, *encoder.encode(blanked, begins))
    assert fine.all() and len(full) == sum(map(bool, raw))
    found = iter([flat[a:b] for a, b in zip(edges[:-1], edges[1:])])
    return [next(found) if r else np.zeros(0, np.int32) for r in raw]


def test_pieces_round_trip_and_best_score(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    byte = set(vocabulary.byte_ids.tolist())
    surface = [vocabulary.surface[a : a + n].tobytes() for a, n in zip(vocabulary.begins, vocabulary.sizes)]
    known = {s.decode(): vocabulary.scores[i] for i, s in enumerate(surface) if i not in byte and s}
    for text, ids in zip(TEXTS, encoded_texts(encoder, TEXTS)):
        assert encoder.decode(ids).tobytes().decode()[1:] == text
        if pieces.MARK in text or len(text) > 500 or not text:
            continue
        s = " " + text
        best = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 48), j):
                best[j] = max(best[j], best[i] + known.get(s[i:j], float("-inf")))
            if s[j - 1] not in known:
                best[j] = max(best[j], best[j - 1] + vocabulary.unknown)
        got, rest = 0.0, ids.tolist()
        while rest:
            if rest[0] in byte:
                lead = surface[rest[0]][0]
                got += vocabulary.unknown
                rest = rest[1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 :]
            else:
                got += vocabulary.scores[rest.pop(0)]
        assert abs(got - best[-1]) < 1e-6


def test_pieces_of_long_texts_and_colliding_hashes(vocabulary, monkeypatch):
    import random

    rng = random.Random(2)
    words = [f"wörd{k}" for k in range(3000)] + ["▁", "\n", " ", "x" * 50]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 0, 700, 120_000, 3)] + ["y" * 20_000]
    whole = [x.tolist() for x in encoded_texts(pieces.Encoder(vocabulary), texts)]
    alone = [encoded_texts(pieces.Encoder(vocabulary), [t])[0].tolist() for t in texts]
    assert whole == alone
    small = pieces.Encoder(vocabulary)
    small.KEPT = 50
    assert [encoded_texts(small, [t])[0].tolist() for t in texts] == whole
    honest = pieces.range_hashes
    monkeypatch.setattr(pieces, "range_hashes", lambda d, s, e: honest(d, s, e) % 7)
    assert [x.tolist() for x in encoded_texts(pieces.Encoder(vocabulary), texts[:3])] == whole[:3]


def test_trie_finds_exactly_its_keys():
    trie = pieces.DoubleArray([(b"ab", 1), (b"abc", 2), (b"b", 3), ("é".encode(), 4)])

    def get(key):
        node = 0
        for c in key:
            child = trie.base[node] + c + 1
            if child >= len(trie.check) or trie.check[child] != node:
                return None
            node = child
        return int(trie.value[node])

    assert [get(k) for k in (b"ab", b"abc", b"b", "é".encode(), b"a", b"x", b"abcd")] == [1, 2, 3, 4, -1, None, None]


def test_pieces_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    out = pieces.encoded(docs(spark, rows, True))
    assert out.where("not round_trip").count() == 0
    null = out.where("doc_id = 99").first()
    assert null.ids is None and null.n_tokens == 0
    back = {r.doc_id: r.text for r in pieces.decoded(out).collect()}
    assert back == dict(rows)


def test_quality_counts_by_hand(spark):
    t = quality_rules.Text("a b c a b c d")
    assert (len(t.words), t.repeated_words, t.word_chars) == (7, 6, 7)
    assert quality_rules.Text("x x x x").repeated_words == 4 and quality_rules.Text("x x x").repeated_words == 0
    assert quality_rules.Text("q\nq\n \n \nq").duplicate_lines == 2
    rows = {r.doc_id: r for r in quality_rules.measured(docs(spark, ODD, True)).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[4].n_words == 60 and rows[4].kept and not rows[7].kept
    assert quality_rules.measured(docs(spark, [])).count() == 0


def test_cascade_verdict_does_not_depend_on_order(spark):
    df = docs(spark, [(i, t) for i, t in enumerate([BASE, BASE + " ### $$$ %%%" * 30, "WOW!!! " * 80, "x " * 80, None, ""])])
    one = sorted(tuple(r) for r in quality_rules.judged(df, quality_rules.RULES).collect())
    assert one == sorted(tuple(r) for r in quality_rules.judged(df, quality_rules.RULES[::-1]).collect())
    order = quality_rules.estimated_order(df)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)


def test_warc_round_trip(spark, tmp_path):
    big, page = "é" * 80, "page_id long, url string, html string"
    rows = [(5, "http://a/x", big), (3, "http://b/y", big), (9, None, big), (1, "http://c", "small"), (2, "http://d", "small"), (4, "http://e", None), (6, "http://f", ""), (None, "http://g", big), (7, "http://h", "head\r\n\r\nWARC/1.1\r\nbody " * 20)]
    warc.write_archives(spark.createDataFrame(rows, page), str(tmp_path / "w"), captures=2)
    records = warc.read_records(spark, str(tmp_path / "w"))
    found = {}
    for r in warc.with_originals(warc.assemble(records)).collect():
        f = r.metadata.fields
        found[f.get("page-id")] = (r.response.rec_type, r.original and r.original.fields["page-id"], r.response.payload_digest, int(f["payload-bytes"]), r.n_requests, r.n_metadata, r.response.payload)
    for i, _, html in rows:
        kind, original, digest, size, requests, metadata, payload = found[None if i is None else str(i)]
        data = (html or "").encode()
        assert (digest, size, requests, metadata) == (hashlib.sha256(data).hexdigest(), len(data), 1, 1)
        assert (kind, original) == (("revisit", "3") if i in (5, 9) else ("response", None))
        assert payload == (None if kind == "revisit" else data)
    assert warc.unassembled(records, warc.assemble(records)).count() == 0
    lone = spark.createDataFrame([("request", "r1", "nothing", None, None, None, None, None, None)], warc.RECORD)
    assert warc.unassembled(records.unionByName(lone), warc.assemble(records)).count() == 1
    warc.write_archives(spark.createDataFrame([], page), str(tmp_path / "e"))


def test_warc_repeated_rows_and_extra_columns(spark, tmp_path):
    big = "text " * 40
    rows = [(1, "http://a", big), (1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (3, "http://c", "x"), (3, "http://d", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("extra") for c in ("digest", "original", "size", "n", "__id", "__digest", "payload")})
    warc.write_archives(pages, str(tmp_path / "w"))
    found = [(r.metadata.fields["page-id"], r.response.rec_type, r.original and r.original.fields["page-id"]) for r in warc.with_originals(warc.assemble(warc.read_records(spark, str(tmp_path / "w")))).collect()]
    assert sorted(found, key=str) == sorted([("1", "response", None)] * 2 + [("2", "revisit", "1")] * 2 + [("3", "response", None)] * 2, key=str)


def test_warc_parse_stops_at_a_broken_tail():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    read = lambda data: [b for _, b in warc.parse_records(warc.Pieces(data))]
    assert read(good + good[:-8]) == [b"abc"] and read(gzip.compress(good * 3)) == [b"abc"] * 3
    assert read(b"") == [] and read(b"junk") == []


@pytest.mark.parametrize("size", ["²", "9" * 5000, "-1", "", "3.0", "٣", "1 2", "99999999999"])
def test_warc_headers_that_are_no_numbers_are_unread(spark, tmp_path, size):
    good = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: r1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = f"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: {size}\r\n\r\nabc\r\n\r\n".encode()
    (tmp_path / "bad.warc").write_bytes(good + bad + good)
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.rec_type, r.record_id) for r in rows] == [("request", "r1"), ("unread", None)]
    assert rows[1].fields == {"offset": str(len(good)), "bytes": str(len(bad) + len(good))}


def test_warc_holds_a_piece_of_an_archive_at_a_time():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1000000\r\n\r\n" + b"a" * 1_000_000 + b"\r\n\r\n"
    packer = zlib.compressobj(wbits=31)
    raw = b"".join([packer.compress(record) for _ in range(150)] + [packer.flush()])
    tracemalloc.start()
    try:
        assert sum(len(b) for _, b in warc.file_records(raw, "x")) == 150_000_000
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()
    broken = gzip.compress(record * 2)
    broken = broken[: len(broken) // 2] + bytes(40) + broken[len(broken) // 2 + 40 :]
    assert [h["warc-type"] for h, _ in warc.file_records(broken, "x")][-1] == "unread"


def test_warc_reads_all_members_and_reports_what_is_unread(spark, tmp_path):
    record = lambda i: f"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: r{i}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    members = [gzip.compress(record(i)) for i in range(2000)]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "plain.warc").write_bytes(record(2000) + b"junk\r\n\r\n" + record(1))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(2001)) + members[0][:-9])
    (tmp_path / "padded.txt.gz").write_bytes(gzip.compress(record(2002)) + b"\0" * 512)
    (tmp_path / "many.warc.cdx").write_bytes(b"index")
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.rec_type == "request" and r.record_id != "r0") == sorted(f"r{i}" for i in range(1, 2003))
    unread = {r.target_uri.rsplit("/", 1)[1]: r.fields for r in rows if r.rec_type == "unread"}
    assert set(unread) == {"plain.warc", "cut.warc.gz"}
    assert unread["plain.warc"] == {"offset": str(len(record(2000))), "bytes": str(8 + len(record(1)))}


def test_toxicity_grammar_scores_clauses():
    scorer = toxicity.Scorer(toxicity.Model())
    total = lambda text: scorer.features(text)[0]
    assert total("a fine day") == 0 and total("") == 0
    assert total("you idiot") > total("an idiot") > total("not an idiot") > 0
    assert total("an idiot") > total("he said idiot") * 0.99 and total("they said an idiot") < total("they are an idiot")
    assert total("you will kill") > total("kill") > 0
    assert total("i will kill you") == total("you i will kill") > 2 * total("i will kill") and total("idiot you") == total("you idiot")
    assert total("kill. you") == total("kill") and total("will not kill you") < total("will kill you")
    assert total("not today. an idiot") == total("today. an idiot")


def test_toxicity_learns_and_handles_odd_rows(spark):
    text = lambda i, bad: " ".join([f"plain{k}" for k in range(i % 7, i % 7 + 20)] + (["grumzel" + "abcd"[i % 4], "grumzelx"] if bad else []))
    rows = [(i, text(i, i % 3 == 0)) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (300, None, None)], LABELS)
    df = docs(spark, rows + [(300, None), (301, "")], True)
    model = toxicity.fit(df, labels)
    assert any("grumzelab".startswith(p) for p in model.prefixes)
    scores = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert all((scores[i] >= 0.3) == (i % 3 == 0) for i in range(240)) and scores[300] == scores[301] < 0.3
    assert sorted(r.doc_id for r in toxicity.drop_toxic(df, model).select("doc_id").collect()) == sorted([i for i in range(240) if i % 3] + [300, 301])
    empty = toxicity.fit(docs(spark, []), spark.createDataFrame([], LABELS))
    assert toxicity.scored(docs(spark, ODD), empty).count() == len(ODD)


def test_quality_model_learns_and_handles_odd_rows(spark):
    good = lambda i: " ".join(f"Word{i % 5} and other{k} things." for k in range(15))
    bad = lambda i: " ".join(f"WORD{k}!! %%%" for k in range(15 + i % 3))
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(None, 0, 0)], LABELS)
    df = docs(spark, rows + [(300, None), (301, "")], True)
    scores = {r.doc_id: r.score for r in quality_model.scored(df, quality_model.fit(df, labels)).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i in range(160)) and scores[300] == scores[301] and 0 <= scores[300] <= 1
    empty = quality_model.fit(docs(spark, []), spark.createDataFrame([], LABELS))
    assert {r.score for r in quality_model.scored(docs(spark, ODD), empty).collect()} == {0.5}


def test_language_id_keeps_languages_whose_rows_repeat_an_id(spark):
    learnt = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learnt[0], f"der die das und nicht ein haus {k % 7}", "de") for k in range(2000)] + [(i, f"the house and not a {i} tree of it", "en") for i in range(600)]
    rows += [(learnt[1], "le chat et la maison", "fr")] * 500 + [(None, "el gato y la casa", "es")] * 5
    model = language_id.fit(docs(spark, rows))
    assert sorted(set(model.languages)) == ["de", "en", "fr"]
    found = {r.doc_id: r.lang_pred for r in language_id.predicted(docs(spark, [(1, "das haus und die"), (2, "the tree and it"), (3, "la maison et le")]), model).collect()}
    assert found == {1: "de", 2: "en", 3: "fr"}
    with pytest.raises(ValueError):
        language_id.fit(docs(spark, rows), most_languages=2)


def test_language_id(spark):
    words = {"aa": "kalo mira tuno vesa", "bb": "schrupf knacht pflitz zwerg", "cc": "oiseau queux jardin lieux"}
    rows = [(i, " ".join(words[g].split()[(i + k) % 4] for k in range(25)), g) for i in range(120) for g in [list(words)[i % 3]]]
    df = docs(spark, rows + [(500, None, "aa"), (501, "123 !?", "aa"), (502, "kalo mira", None), (503, "", "bb"), (504, "² ½ ① 7", "aa")], True)
    found = {r.doc_id: r for r in language_id.predicted(df, language_id.fit(df)).collect()}
    assert all(found[i].lang_pred == g and 0 < found[i].score <= 1 for i, _, g in rows)
    assert [found[i].lang_pred for i in (500, 501, 502, 503, 504)] == ["und", "und", "aa", "und", "und"]
    assert language_id.letters_of("Ab²c ½ 1-d") == "ab c d" and language_id.letters_of("Éa_b") == "éa b" and language_id.letters_of("") == ""
    empty = language_id.fit(docs(spark, []))
    assert {r.lang_pred for r in language_id.predicted(docs(spark, ODD), empty).collect()} == {"und"}


def test_shingle_sets_follow_the_text_boundaries():
    import numpy as np

    texts = ["a b c d e", "", "A B C", "x", " a  b c\td e "]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    sets = [np.frombuffer(x, np.uint64).tolist() for o in near_dedup.full_sets(4)(iter([batch])) for x in o.column("items").to_pylist()]
    assert [len(s) for s in sets] == [2, 0, 1, 1, 2] and sets[0] == sets[4]
