"""Order-preserving packing of documents into token sequences.

The documents of a partition, in their order, are one stream of token ids.  A
dynamic program over the stream's cut points (ends of documents and sentences,
and full windows after them) chooses windows of at most ``length`` tokens that
minimise padding plus a penalty for each cut inside a document.  The best start
of a window ending at p minimises ``cost(i) + i`` over the cut points in
``[p - length, p)``, so a monotone queue makes every transition constant time;
windows whose length is a power of two need no padding and are tried besides.

Partitions are packed on their own and without any shuffle; a partition's
unfinished window is carried from block to block and only its last is partial.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from lacuna.llm.shared import small_batches, tidied

#: Cost, in tokens of padding, of a cut at the end of a sentence and at any other place in a document.
SENTENCE_CUT = 1
HARD_CUT = 6
#: Tokens that are planned at a time; units that a worker remembers.
BLOCK_TOKENS = 1 << 18
REMEMBERED = 1_500_000
_SEQUENCES = 1 << 33
_GRID = 256
#: Texts with other white space than single blanks and newlines between words, or with what may be a special token, are encoded as a whole.
_ODD = tuple("\x00\x01\t\x0b\x0c\r\x1c\x1d\x1e\x1f") + ("  ", "\n\n", " \n", "\n ", "<|")
_ODD_WIDE = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def odd(text: str) -> bool:
    """Whether a text that is not empty must be encoded as a whole; plain searches, as a pattern takes far longer."""
    return text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _ODD)) or not text.isascii() and any(map(text.__contains__, _ODD_WIDE))


class _Places(dict):
    """The place of each unit; a new one gets the next place and is noted in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        self.fresh.append(unit)
        return place


class Encoder:
    """Byte-level BPE ids of texts, remembering the ids of white-space-led units.

    The vocabulary's splitting pattern never takes a non-blank and the blank
    after it into one piece, so a text's ids are those of its units in turn.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.blank = np.array([t[:1] in ("Ġ", "Ċ") for t in tokens])
        self.stop = np.array([t[-1:] in (".", "!", "?", "Ċ") for t in tokens])
        self._clear()

    def _clear(self) -> None:
        self.of = _Places()
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.at, self.len = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _learn(self) -> None:
        """Encodes the fresh units, most of them in long runs that are cut before each led token."""
        units, self.of.fresh = self.of.fresh, []
        first = len(self.of) - len(units)
        while len(self.of) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.len))
        heads = np.array([u[:1] == "\x01" for u in units])
        led = [u if u[0] == "\n" else " " + u for u in units if u[:1] != "\x01"]
        parts, lengths = [], []
        for k, ids in enumerate(self._whole(["".join(led[i : i + 512]) for i in range(0, len(led), 512)])):
            own = led[k * 512 : (k + 1) * 512]
            cuts = np.flatnonzero(self.blank[ids])
            if len(cuts) == len(own):
                parts.append(ids)
                lengths.append(np.diff(np.append(cuts, len(ids))))
            else:
                alone = self._whole(own)
                parts += alone
                lengths.append(np.array([len(x) for x in alone]))
        alone = self._whole([u[1:] for u in units if u[:1] == "\x01"])
        parts += alone
        lengths.append(np.array([len(x) for x in alone], np.int64))
        ids, n = np.concatenate(parts), np.concatenate(lengths).astype(np.int64)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        place = first + np.concatenate([np.flatnonzero(~heads), np.flatnonzero(heads)])
        self.len[place] = n
        self.at[place] = self.used + np.cumsum(n) - n
        self.used += len(ids)

    def encode(self, texts: list[str | None], remember: int = REMEMBERED) -> list[np.ndarray]:
        """The ids of each text; none for null and empty ones."""
        if len(self.of) > remember:
            self._clear()
        places: list[np.ndarray | None] = []
        for text in texts:
            if not text or odd(text):
                places.append(None)
                continue
            units = text.replace("\n", " \n").split(" ")
            units[0] = "\x01" + units[0]
            places.append(np.fromiter(map(self.of.__getitem__, units), np.int64, len(units)))
        if self.of.fresh:
            self._learn()
        out = []
        for text, k in zip(texts, places, strict=True):
            if k is None:
                out.append(self._whole([text])[0] if text else np.empty(0, np.int32))
                continue
            n = self.len[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.at[k] - ends + n, n) + np.arange(ends[-1])])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, from 0 to ``total``, and the penalty of each."""
    penalty = np.full(total + 1, -1, np.int64)
    natural = np.concatenate([[0], sentence_ends, doc_ends])
    full = natural + length
    penalty[full[full <= total]] = HARD_CUT
    marks = np.unique(np.concatenate([natural, [total]]))
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        if b - a > _GRID:
            penalty[np.arange(a + _GRID, b, _GRID)] = HARD_CUT
    penalty[sentence_ends] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = 0
    if penalty[total] < 0:
        penalty[total] = HARD_CUT
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def plan(at: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> list[int]:
    """The chosen window ends.

    With ``last`` the final window ends at the last point; otherwise what
    follows the best point within its reach is left over for later.
    """
    pos, pen = at.tolist(), penalty.tolist()
    place = {p: i for i, p in enumerate(pos)}
    shorter = [length >> k for k in (1, 2) if length & (length - 1) == 0 and length >> k]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue, keys, head = [0], [pos[0]], 0
    for j in range(1, len(pos)):
        p = pos[j]
        least = p - length
        while pos[queue[head]] < least:
            head += 1
        best, start = keys[head] + length - p, queue[head]
        for n in shorter:
            i = place.get(p - n)
            if i is not None and cost[i] < best:
                best, start = cost[i], i
        cost[j] = best = best + pen[j]
        back[j] = start
        key = best + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    j = len(pos) - 1
    if not last:
        reach = [i for i in range(len(pos)) if pos[i] > pos[-1] - length]
        j = min(reach, key=lambda i: (cost[i], -i))
    ends = []
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = "doc_id {}, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _pack(path: str, length: int, end_id: int, id_type: pa.DataType, with_ids: bool, remember: int, keep: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        sequence = TaskContext.get().partitionId() * _SEQUENCES
        # the stream not yet packed: ids, and of each document segment the id, start, tokens and length
        pieces: list[np.ndarray] = []
        segments: list[tuple] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal sequence, pieces, segments, held
            ids = np.concatenate(pieces)
            lengths = np.array([s[3] for s in segments], np.int64)
            doc_ends = np.cumsum(lengths)
            blank_next = np.append(coder.blank[ids[1:]] | (ids[1:] == end_id), True)
            sentences = np.flatnonzero(coder.stop[ids] & blank_next) + 1
            at, penalty = cut_points(doc_ends, sentences, len(ids), length)
            ends = np.array(plan(at, penalty, length, last), np.int64)
            if not len(ends):
                return None
            done = ends[-1]
            starts = np.concatenate([[0], ends[:-1]])
            doc_starts = doc_ends - lengths
            cuts = np.unique(np.concatenate([starts, doc_starts[doc_starts < done]]))
            sizes = np.diff(np.append(cuts, done))
            doc = np.searchsorted(doc_ends, cuts, side="right")
            window = np.searchsorted(ends, cuts, side="right")
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(cuts.tolist(), sizes.tolist(), strict=True)]
            first = np.array([s[1] for s in segments], np.int64)
            total = np.array([s[2] for s in segments], np.int64)
            values = [first[doc] + cuts - doc_starts[doc], sizes, np.array(crc, np.int64), total[doc], sequence + window, cuts - starts[window]]
            arrays = [pa.array([segments[d][0] for d in doc], id_type), *map(pa.array, values)]
            names = ["doc_id", *_COLUMNS]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(cuts, done).astype(np.int32)), pa.array(ids[:done], pa.int32())))
                names.append("ids")
            sequence += len(ends)
            rest, held = ids[done:], len(ids) - int(done)
            kept = []
            for s, a, b in zip(segments, doc_starts.tolist(), doc_ends.tolist(), strict=True):
                if b > done:
                    gone = max(0, int(done) - a)
                    kept.append((s[0], s[1] + gone, s[2], s[3] - gone))
            pieces, segments = [rest], kept
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start in range(0, batch.num_rows, 64):
                texts = batch.column("text").slice(start, 64).to_pylist()
                for name, ids in zip(names[start : start + 64], coder.encode(texts, remember), strict=True):
                    pieces.append(np.append(ids, np.int32(end_id)))
                    segments.append((name, 0, len(ids) + 1, len(ids) + 1))
                    held += len(ids) + 1
                if held >= BLOCK_TOKENS and (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out
        if not keep:
            _encoders.pop(path, None)
        elif len(coder.of) > remember:
            coder._clear()

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, with_ids: bool = False, remember: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a byte-level BPE file that every executor can
    read.  Each document is its ids and then ``end_id``; a null or empty text is
    ``end_id`` alone.  Every id lies in one piece.  Rows are packed in the
    order in which the table is read, partition by partition, so equal rows and
    null doc_ids (of any plain type) are documents of their own; other columns are ignored; an empty
    table has no pieces.  A sequence is padded to ``length`` unless its length is
    a power of two.  ``remember`` bounds the units that a worker keeps between
    partitions (about 200 bytes each); with ``keep=False`` it keeps neither them nor the tokenizer.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = SCHEMA.format(kind.simpleString()) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(tidied(_pack(tokenizer, length, end_id, id_type, with_ids, remember, keep)), schema)
