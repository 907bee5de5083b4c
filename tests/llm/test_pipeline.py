"""The pipeline on the smallest tables."""

from collections import Counter
from hashlib import sha256

import corpus_pipeline
from pyspark.sql import functions as F

from tidewatch.llm.common import read


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids, name
        docs, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.where(~F.col("round_trip")).count() == 0


def brute_mixture(rows, marks, weights=(5, 2, 1), share=1.5, most=2.0):
    """Copies of each (id, text, source) by the definition: an epoch takes a prefix of a source's shuffled stream."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    words = {s: sum(len(r[1].split()) for r in rows if r[2] == s and r[1]) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        enough = sum(min(most * words[s], weight[s] * level) for s in sources) >= share * sum(words.values())
        low, high = (low, level) if enough else (level, high)
    out = Counter()
    for s in sources:
        own = Counter((r[0], r[1]) for r in rows if r[2] == s and r[1] and r[1].split())
        stream = sorted((marks[doc_id, text, s, copy], len(text.split()), text, doc_id) for (doc_id, text), n in own.items() for copy in range(n))
        quota = round(min(most * words[s], weight[s] * high))
        for epoch in (0, 1):
            start, end = 0, min(quota - epoch * words[s], words[s])
            for _, size, text, doc_id in stream:
                out[doc_id, text, s] += 2 * max(0, min(size, end - start)) >= size
                start += size
    return +out


def stream_marks(spark, rows):
    """Where each row, and each of those that are alike, stands in its source's shuffled stream."""
    digest = lambda text, s: bytearray(sha256((sha256(("" if s is None else "=" + s).encode()).hexdigest() + text).encode()).digest())
    alike = [(doc_id, text, s, copy) for (doc_id, text, s), n in Counter(r[:3] for r in rows if r[1]).items() for copy in range(n)]
    table = spark.createDataFrame([(*r, len(r[1].split()), digest(r[1], r[2])) for r in alike], "doc_id long, text string, source string, copy long, size long, digest binary")
    found = table.select("doc_id", "text", "source", "copy", F.xxhash64("doc_id", "size", "digest", "copy", F.lit("shuffle")).alias("mark")).collect()
    return {(r.doc_id, r.text, r.source, r.copy): r.mark for r in found}


def test_mixture_of_odd_rows_against_the_definition(spark):
    rows = [(i, f"w{i} " * (3 + i * 7 % 50), f"s{i % 3}") for i in range(1, 120)]
    rows += [(None, f"null {k} " * (1 + k % 9), f"s{k % 3}" if k % 5 else None) for k in range(60)]
    rows += [(7, f"again {k % 6} " * (1 + k % 12), f"s{k % 3}") for k in range(60)] + [(500, "copy of it", "s1")] * 40 + [(None, "copy of it", "s1")] * 40
    rows += [(600, "", "s0"), (601, None, "s0"), (None, " \n ", "s1"), (None, None, None), (1, "", "s2")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    got = mixed.collect()
    expected = brute_mixture(rows, stream_marks(spark, rows))
    assert Counter((r.doc_id, r.text, r.source) for r in got) == expected
    assert max(Counter(r.n_chars for r in got).values()) == 2 and any(k[0] is None for k in expected)
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(5), "").collect()))


def test_stages_on_odd_rows_clashing_names_and_an_empty_table(spark, sf_dir):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", None), (None, "text without an id", None, "b"), (None, base, "en", "b"), (4, base, "en", "a"), (4, base, "en", "a"), (5, base + " tail", "en", "a"), (6, "é" * 3000, "fr", None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(None).cast("long"))
    odd = plain.withColumns({c: F.lit(1) for c in ("__keep", "__sha", "__rows", "__id", "digest", "node", "kept", "times", "size", "slot", "target", "key", "piece", "epoch", "mark", "score", "label")})
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, none = stage(spark, odd, sf_dir), stage(spark, odd.limit(0), sf_dir)
        assert out.columns == odd.columns == none.columns and none.count() == 0, name
        found = ids(out)
        if name == "toxicity":
            assert found == ids(odd)
        elif name == "exact_dedup":
            assert found == Counter([1, 3, None, 4, 5, 6])
        elif name == "near_dedup":
            assert found == Counter([1, 2, 3, None, None, 4, 4, 6])
        else:
            assert set(found) <= {None, 4, 5, 6} and max(found.values()) <= 4
    out = {(r.doc_id, r.ids is None, r.n_tokens == 0, r.round_trip) for r in stages["encoding"](spark, odd, sf_dir).collect()}
    assert {r for r in out if r[0] in (1, 2)} == {(1, True, True, True), (2, False, True, True)} and all(r[3] for r in out)
    assert stages["encoding"](spark, odd.limit(0), sf_dir).count() == 0
