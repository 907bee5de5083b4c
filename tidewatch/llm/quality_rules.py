"""Quality rules as a short-circuit cascade.

Each rule computes its own figure from a text and rejects it or not. On a sample, every rule's time per document and share
of rejections are measured; the cascade then runs the rules by rejections per second of cost, and a document's first
rejection ends its row. The verdict is the same in any order, only the cost differs.

Null and empty texts have no words and are rejected by the first rule of the base set, `n_words`. Repeated rows are judged
alike. Extra columns are ignored. Whole texts are read; the repetition count works on arrays of word numbers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: About how many documents the order of the rules is estimated on.
SAMPLE = 2_000


class Text:
    """A text with the figures that rules need, each computed when first asked for, and once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def duplicate_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more, the first occurrence included."""
        words = self.words
        if len(words) < 4:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, m = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)
        pair = ids[:-1] * m + ids[1:]
        if m >= 1 << 21:  # keep the products in 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        triple = pair[:-1] * m + ids[2:]
        order = np.argsort(triple, kind="stable")
        equal = triple[order][1:] == triple[order][:-1]
        again = np.zeros(len(triple), bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(again) + k] |= again
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE = (
    Rule("n_words", lambda t: len(t.words) < 50),
    Rule("repeat_words", lambda t: 100 * t.repeated_words > 50 * len(t.words)),
)
RULES = BASE + (
    Rule("symbols", lambda t: 4 * t.symbols > len(t.words)),
    Rule("duplicate_lines", lambda t: 2 * t.duplicate_lines > len(t.lines)),
    Rule("word_length_low", lambda t: 2 * len(t.words) > t.word_chars),
    Rule("word_length_high", lambda t: t.word_chars > 20 * len(t.words)),
    Rule("exclamations", lambda t: 2 * t.text.count("!") > len(t.words)),
)


def cascade(text: Text, rules: tuple[Rule, ...]) -> str | None:
    """Name of the first rule that rejects the text, or None."""
    for rule in rules:
        if rule.rejects(text):
            return rule.name
    return None


def estimated_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE) -> tuple[Rule, ...]:
    """Rules by rejections per second on about `rows` documents, picked by a hash of the id at a rate that follows the size
    of the table. The sample is measured where it lies; one short row per rule and task is summed up and reaches the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += 1
                for i, rule in enumerate(rules):
                    own = Text(text.as_py())  # no rule profits from what another has computed
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(own)
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64()), pa.array([seen] * len(rules), pa.int64())], names=["rule", "seconds", "rejected", "seen"])

    rate = min(1.0, rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 30)) < int(rate * (1 << 30))).select("text")
    found = sample.mapInArrow(measure, "rule int, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen")).collect()
    gain = {r: ((rejected + 0.5) / (seen + 1)) / (max(seconds, 1e-9) / max(1, seen)) for r, seconds, rejected, seen in found}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, kept): the cascade alone, in the estimated order unless rules are given."""
    order = estimated_order(docs) if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cascade(Text(t.as_py()), order) is None for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.bool_())], names=["doc_id", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kept boolean")


def measured(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The base figures are reported for all documents; the rest of the cascade runs only where the base rules pass, on the
    figures that are there already.
    """
    order = estimated_order(docs) if rules is None else rules
    rest = tuple(r for r in order if r not in BASE)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed, kept = [], [], []
            for value in batch.column("text"):
                text = Text(value.as_py())
                n, repeated = len(text.words), text.repeated_words
                rows.append((n, text.word_chars, text.symbols, text.duplicate_lines, repeated))
                failed.append(n < 50 or 100 * repeated > 50 * n)
                kept.append(not failed[-1] and cascade(text, rest) is None)
            figures = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *figures, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
