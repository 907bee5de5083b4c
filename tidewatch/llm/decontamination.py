"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items; every text is
scanned once, and what is hit is mapped back to the original.

Normalised, a text is its words: runs of digits, letters a to z (A-Z in lower case) and characters beyond ASCII. Words are
the automaton's alphabet. A window is `width` consecutive words of an item; an item of fewer words, but not none, is one
window. A document's word is hit if it lies inside any occurrence of a window.

The benchmark is counted first. Up to `most` windows are one automaton, which is broadcast; more are dealt over several by
hash, each scans all texts, and what they hit is merged by id and text. So the automaton's size is bounded and no window is
left out.

Null and empty texts have no words. Rows of the benchmark without id mark words but are not listed; rows that repeat an id
are one item. Rows of documents that repeat an id are scanned each. Extra columns are ignored. Without items nothing is hit;
an empty table of documents gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What the bytes of a text become: A-Z lower case, other ASCII than words a blank.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Windows of one automaton: at most `width` states each, and some 100 bytes a state.
MOST = 100_000

SPANS = "array<struct<first: long, last: long, begin: long, end: long>>"
FOUND = f"doc_id long, n_words long, n_hit long, spans {SPANS}, items array<string>"


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, items): every distinct window as an array of words, with the ids, as text, of the items that hold it."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    windows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items"))


class _Numbers(dict):
    """The words of the windows by number; any other is 0, which no window holds."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Scanner:
    """The automaton of a list of (window, items); walks over the words of one text at a time."""

    def __init__(self, windows: Iterable[tuple[list[str], list[str]]]):
        self.numbers, self.lengths, self.items = _Numbers(), [], []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words, items in windows:
            key = tuple(self.numbers.setdefault(w.encode(), len(self.numbers) + 1) for w in words)
            self.automaton.add_word(key, len(self.lengths))
            self.lengths.append(len(key))
            self.items.append(items)
        if self.lengths:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[list[int]], list[str]]:
        """Number of words, the runs of hit words (first and last word, first and behind the last character of the original)
        and the items found."""
        normal = text.translate(NORMAL)
        words = normal.split()
        if not self.lengths or not words:
            return len(words), [], []
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        for last, window in self.automaton.iter(tuple(map(self.numbers.__getitem__, words))):
            seen.add(window)
            first = last - self.lengths[window] + 1
            while runs and first <= runs[-1][1] + 1:
                first = min(first, runs.pop()[0])
            runs.append((first, last))
        return len(words), spans(text, normal, runs) if runs else [], sorted({i for w in seen for i in self.items[w]})


def spans(text: bytes, normal: bytes, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of words with their places in the original, in characters."""
    inside = np.concatenate(([0], (np.frombuffer(normal, np.uint8) != 32).astype(np.int8), [0]))
    edges = np.diff(inside)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    characters = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [[first, last, int(characters[begins[first]]), int(characters[ends[last]])] for first, last in runs]


def merged(parts: Iterable[list[int]]) -> list[list[int]]:
    """Spans of several scans of one text as disjoint ones in order."""
    out: list[list[int]] = []
    for first, last, begin, end in sorted(parts):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, end
        else:
            out.append([first, last, begin, end])
    return out


#: The scanner that this worker built last, by the name of its list of windows.
_built: dict[str, Scanner] = {}


def _scanner(name: str, windows: Broadcast) -> Scanner:
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(windows.value)
    return _built[name]


def _struct(rows: list[list[list[int]]]) -> pa.Array:
    names = ("first", "last", "begin", "end")
    return pa.array([[dict(zip(names, s)) for s in row] for row in rows], pa.list_(pa.struct([(n, pa.int64()) for n in names])))


def _scanned(docs: DataFrame, windows: DataFrame, hit_only: bool = False) -> DataFrame:
    """doc_id, digest of the text and what one automaton finds in it."""
    name, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in windows.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(name, held)
        for batch in batches:
            ids, digests, rows = [], [], []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                text = value.as_py() or b""
                row = scanner.scan(text)
                if row[1] or not hit_only:
                    ids.append(doc_id)
                    rows.append(row)
                    digests.append(hashlib.sha256(text).digest() if row[1] else None)
            hit = [sum(s[1] - s[0] + 1 for s in r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(hit, pa.int64()), _struct([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(digests, pa.binary())],
                names=["doc_id", "n_words", "n_hit", "spans", "items", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{FOUND}, digest binary")


def found(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (runs of hit words: first and last word, begin and end in the
    original's characters) and items (ids as text, sorted)."""
    windows = written(item_windows(benchmark, width), "windows")
    shards = max(1, -(-windows.count() // most))
    if shards == 1:
        return _scanned(docs, windows).drop("digest")
    part = F.pmod(F.xxhash64("window"), F.lit(shards))
    every = None
    for k in range(shards):
        own = written(_scanned(docs, windows.where(part == k), hit_only=True).dropDuplicates(["doc_id", "digest"]), "scan")
        every = own if every is None else every.unionByName(own)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [merged([list(s.values()) for part in parts for s in part]) for parts in batch.column("spans").to_pylist()]
            items = [sorted({i for part in parts for i in part}) for parts in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([sum(s[1] - s[0] + 1 for s in r) for r in rows], pa.int64()), _struct(rows), pa.array(items, pa.list_(pa.string()))], names=["id", "digest", "n_hit", "spans", "items"])

    # One short row per document that is hit; the many that are not keep no digest, so none is hot.
    hits = every.groupBy("doc_id", "digest").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    hits = hits.mapInArrow(merge, f"id long, digest binary, n_hit long, spans {SPANS}, items array<string>")
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(low, F.lit(WORD)).cast("long").alias("n_words"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("own"))
    joined = counts.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left")
    none = F.array()
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none.cast(SPANS)).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))
