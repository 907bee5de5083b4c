"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary file gives pieces by rank; a piece's log score follows the rank-frequency law, -log(1 + rank) less the
logarithm of the normaliser. A text is encoded as whitespace marker + text with blanks turned into markers. A character
that no single piece holds may fall back to its UTF-8 bytes, at a score below all others. No piece has a marker after
another character, so a text falls into segments (blanks + what follows up to the next blank) that are encoded once per
distinct segment, many at a time, with numpy. Segments are told apart by 64-bit hashes of their bytes; what was found is
kept in a bounded table of flat ids, and texts are encoded and decoded by gathering from flat arrays.

decode(encode(text)) == text for every text, and every text is decoded and compared: a literal marker character goes
through byte fallback, and a text in which two segments' hashes collide is encoded again segment by segment. Null text has
null ids and no tokens, empty text has no ids. Repeated rows and ids are encoded alike. Extra columns are ignored. Long
texts are encoded whole, CHUNK bytes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import CHUNK, gathered, range_hashes, text_chunks

MARK = "▁"
MARK_BYTES = MARK.encode()
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


class DoubleArray:
    """A byte trie as two arrays: the child of node n by byte c is t = base[n] + c + 1 if check[t] == n. Node 0 is the root."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        entries = sorted(entries)
        size = 4 * sum(len(k) for k, _ in entries) + 1024
        base, value = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        check = np.full(size, -1, np.int32)
        check[0] = 0
        begin_at = [1] * 258  # where the search begins, by number of children: slots below are mostly taken
        last = 0
        todo = [(0, 0, len(entries), 0)]
        for node, low, high, depth in todo:
            if low < high and len(entries[low][0]) == depth:
                value[node] = entries[low][1]
                low += 1
            children, at = [], low
            while at < high:
                byte, begin = entries[at][0][depth], at
                while at < high and entries[at][0][depth] == byte:
                    at += 1
                children.append((byte + 1, begin, at))
            if not children:
                continue
            codes = np.array([c for c, _, _ in children])
            offset, window = max(0, begin_at[len(codes)] - int(codes[0])), 64
            while True:
                free = (check[offset + np.arange(window)[:, None] + codes] < 0).all(axis=1)
                if free.any():
                    offset += int(free.argmax())
                    break
                offset, window = offset + window, min(4096, 2 * window)
            begin_at[len(codes)] = offset + int(codes[0])
            base[node] = offset
            check[offset + codes] = node
            last = max(last, offset + int(codes[-1]))
            todo += [(offset + c, begin, end, depth + 1) for c, begin, end in children]
        self.base, self.check, self.value = base[: last + 1].copy(), check[: last + 1].copy(), value[: last + 1].copy()
        self.depth = max((len(k) for k, _ in entries), default=0)


class Vocabulary:
    """Pieces, their log scores, the byte pieces and the trie; read once on the driver and sent to the tasks (about 5 MB)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """pieces: by id (text, log score), with None as text for ids that match nothing; byte_ids: the 256 byte pieces."""
        entries = [(p.encode(), i) for i, (p, _) in enumerate(pieces) if p]
        self.scores = np.array([s for _, s in pieces] or [0.0])
        self.byte_ids = np.array(byte_ids, np.int64)
        self.unknown = float(self.scores.min()) - 10.0
        self.trie = DoubleArray(entries)
        surface = [p.replace(MARK, " ").encode() if p else b"" for p, _ in pieces]
        for byte, i in enumerate(byte_ids):
            surface[i] = bytes([byte])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(n)]
        total = math.log(sum(1 / (1 - model.get_score(i)) for i in range(n) if normal[i]))
        pieces = [(model.id_to_piece(i), -math.log1p(-model.get_score(i)) - total) if normal[i] else (None, 0.0) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, _ in pieces if p):
            raise ValueError("a piece has a whitespace marker after another character")
        return cls(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of each segment, with markers for its blanks: all ids one after the other, and the number of each."""
        raw = [s.replace(b" ", MARK_BYTES) for s in segments]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = len(data)
        limit = np.repeat(ends, lengths)
        char = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(char, n))
        # Matches (start, end, piece) from every character, all positions one byte deeper at a time.
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        at, node = char, np.zeros(len(char), np.int64)
        single = np.zeros(n + 1, bool)
        found = []
        char_width = np.zeros(n + 1, np.int64)
        char_width[char] = width
        for depth in range(self.trie.depth):
            here = at + depth
            inside = here < limit[at]
            at, node, here = at[inside], node[inside], here[inside]
            child = base[node] + data[here].astype(np.int64) + 1
            good = check[np.minimum(child, len(check) - 1)] == node
            good &= child < len(check)
            at, node = at[good], child[good]
            if not len(at):
                break
            piece = value[node]
            hit = piece >= 0
            found.append((at[hit], at[hit] + depth + 1, piece[hit], self.scores[piece[hit]]))
            whole = at[hit][char_width[at[hit]] == depth + 1]
            single[whole] = True
        bare = char[~single[char]]
        found.append((bare, bare + char_width[bare], np.full(len(bare), -1), np.full(len(bare), self.unknown)))
        start, end, piece, score = (np.concatenate(x) for x in zip(*found))
        # Viterbi over all segments side by side, by the end within the segment; of equal sums the longest piece wins.
        owner_begin = np.repeat(begins, lengths)
        step = end - owner_begin[start] if len(start) else end
        order = np.lexsort((end - start, step))
        start, end, piece, score, step = (x[order] for x in (start, end, piece, score, step))
        back = np.zeros(n + 1, np.int64)
        edges = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step)) if len(step) else [0]
        reach = np.full(n + 1, -np.inf)  # best sum that ends at a byte; a segment's end is the next one's begin
        for a, b in zip(edges[:-1], edges[1:]):
            s, e = start[a:b], end[a:b]
            sums = np.where(s == owner_begin[s], 0.0, reach[s]) + score[a:b]
            np.maximum.at(reach, e, sums)
            top = sums == reach[e]
            back[e[top]] = np.flatnonzero(top) + a
        # The paths are walked from all ends at once; a turn gives each segment that is not through its next piece.
        owner, at, chosen, owners = np.arange(len(raw)), ends.copy(), [], []
        while len(owner):
            edge = back[at]
            chosen.append(edge)
            owners.append(owner)
            at = start[edge]
            more = at > begins[owner]
            owner, at = owner[more], at[more]
        if not chosen:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner, edge = np.concatenate(owners), np.concatenate(chosen)
        order = np.lexsort((start[edge], owner))
        owner, edge = owner[order], edge[order]
        bare = piece[edge] < 0
        times = np.where(bare, end[edge] - start[edge], 1)
        ids = np.repeat(piece[edge], times)
        in_bytes = np.repeat(bare, times)
        ids[in_bytes] = self.byte_ids[data[gathered(start[edge[bare]], times[bare])]]
        return ids.astype(np.int32), np.bincount(owner, times, len(raw)).astype(np.int64)


def segment_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where segments of the texts begin: at a text, a run of blanks, a line break or literal marker, and after these two."""
    first = np.zeros(len(data) + 1, bool)
    blank, line = data == 32, data == 10
    first[1:-1] = blank[1:] & ~blank[:-1]
    first[:-1] |= line
    first[1:] |= line
    lead = np.flatnonzero(data[: len(data) - 2] == MARK_BYTES[0])
    lead = lead[(data[lead + 1] == MARK_BYTES[1]) & (data[lead + 2] == MARK_BYTES[2])]
    first[lead] = True
    first[lead + 3] = True
    first[begins] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Encodes texts of one task; keeps the ids of at most KEPT distinct segments."""

    KEPT = 400_000
    #: Ids that are decoded at once.
    DECODED = 1 << 18

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.is_byte = np.zeros(len(vocabulary.sizes), bool)
        self.is_byte[vocabulary.byte_ids] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode_all(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode_segments, some 20,000 at a time; a literal marker goes through its bytes."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(segments), 20_000):
            part = segments[a : a + 20_000]
            found, n = self.vocabulary.encode_segments([s for s in part if s != MARK_BYTES])
            if MARK_BYTES in part:
                mark = self.vocabulary.byte_ids[list(MARK_BYTES)].astype(np.int32)
                is_mark = np.array([s == MARK_BYTES for s in part])
                sizes = np.full(len(part), len(mark), np.int64)
                sizes[~is_mark] = n
                n, plain = sizes, np.repeat(~is_mark, sizes)
                every = np.empty(len(plain), np.int32)
                every[plain] = found
                every[~plain] = np.tile(mark, int(is_mark.sum()))
                found = every
            ids.append(found)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _place(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the table for distinct hashes, each with a range of data that has it; learns those that are missing."""
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.KEPT:
                self._forget()
                known = np.zeros(len(hashes), bool)
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids, count = self._encode_all([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            where = np.searchsorted(self.hashes, hashes[new])
            self.at = np.insert(self.at, where, len(self.ids) + np.cumsum(count) - count)
            self.count = np.insert(self.count, where, count)
            self.hashes = np.insert(self.hashes, where, hashes[new])
            self.ids = np.concatenate((self.ids, ids))
            at = np.searchsorted(self.hashes, hashes)
        return at

    def encode(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (bytes one after the other, from their begins), and the edges of each text's ids.

        No text is empty, and each begins with the blank that encoding adds.
        """
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        starts = segment_starts(data, begins)
        ends = np.append(starts[1:], len(data))
        parts, totals = [], [np.zeros(1, np.int64)]
        for a in range(0, len(starts), CHUNK):  # bounds the memory for one long text
            low, high = int(starts[a]), int(ends[min(len(ends), a + CHUNK) - 1])
            s, e, piece = starts[a : a + CHUNK] - low, ends[a : a + CHUNK] - low, data[low:high]
            hashes, first, inverse = np.unique(range_hashes(piece, s, e), return_index=True, return_inverse=True)
            row = self._place(hashes, piece, s[first], e[first])[inverse]
            parts.append(self.ids[gathered(self.at[row], self.count[row])])
            totals.append(self.count[row])
        upto = np.cumsum(np.concatenate(totals))
        edges = np.append(upto[np.searchsorted(starts, begins)], upto[-1])
        return np.concatenate(parts), edges

    def encode_exactly(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text without the table: no two segments are taken for each other."""
        starts = segment_starts(data, np.zeros(1, np.int64))
        raw = data.tobytes()
        segments = [raw[a:b] for a, b in zip(starts.tolist(), np.append(starts[1:], len(data)).tolist())]
        number = {s: i for i, s in enumerate(dict.fromkeys(segments))}
        ids, count = self._encode_all(list(number))
        row = np.array([number[s] for s in segments])
        return ids[gathered((np.cumsum(count) - count)[row], count[row])]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, with blanks for markers; encoding's leading blank is still there."""
        v = self.vocabulary
        return np.concatenate([np.zeros(0, np.uint8), *(v.surface[gathered(v.begins[part], v.sizes[part])] for part in (ids[a : a + self.DECODED] for a in range(0, len(ids), self.DECODED)))])

    def decoded_ends(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where each text ends among the decoded bytes."""
        return np.concatenate(([0], np.cumsum(self.vocabulary.sizes[ids])))[edges[1:]]


def _with_blanks(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that are not empty, each after a blank: which, their bytes and where they begin."""
    sizes = np.diff(np.append(begins, len(data)))
    full = np.flatnonzero(sizes)
    places = begins[full] + np.arange(len(full))
    out = np.full(len(data) + len(full), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[places] = False
    out[keep] = data
    return full, out, places


def _checked(encoder: Encoder, data: np.ndarray, begins: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decodes all texts and compares them with what was encoded; the few that differ are encoded again exactly."""
    decoded = encoder.decode(flat)
    if len(decoded) == len(data) and np.array_equal(decoded, data) and np.array_equal(encoder.decoded_ends(flat, edges)[:-1], begins[1:]):
        return flat, edges, np.ones(len(begins), bool)
    ids, fine = [np.zeros(0, np.int32)], []
    for a, b, low, high in zip(begins.tolist(), np.append(begins[1:], len(data)).tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        own = flat[low:high]
        if not np.array_equal(encoder.decode(own), data[a:b]):
            own = encoder.encode_exactly(data[a:b])
        ids.append(own)
        fine.append(np.array_equal(encoder.decode(own), data[a:b]))
    return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids[1:]]))).astype(np.int64), np.array(fine, bool)


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_byte_tokens, ids, round_trip (decoding gives the text again)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for row, end, data, begins in text_chunks(batch):
                full, blanked, places = _with_blanks(data, begins)
                flat, edges = encoder.encode(blanked, places)
                flat, edges, fine = _checked(encoder, blanked, places, flat, edges)
                sizes, in_bytes, good = np.zeros(end - row, np.int64), np.zeros(end - row, np.int64), np.ones(end - row, bool)
                sizes[full], good[full] = np.diff(edges), fine
                in_bytes[full] = np.diff(np.concatenate(([0], np.cumsum(encoder.is_byte[flat])))[edges])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null[row:end], False)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(sizes), pa.array(in_bytes), lists, pa.array(good)], names=["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give null text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            raw, ends = encoder.decode(flat).tobytes(), encoder.decoded_ends(flat, edges).tolist()
            texts = [raw[a:b][1:].decode("utf-8", "replace") if good else None for a, b, good in zip([0, *ends], ends, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
