"""Packing: sum-of-squares online packing of documents into sequences of a fixed number of tokens.

A document is its ids and one end id. What fills whole sequences leaves at once; the rest goes, as it
comes, into the open sequence whose choice leaves the smallest sum, over fill levels, of the squared number
of sequences partly filled to that level (Csirik et al.). The counts stand in an array by level. Documents
may be cut: once `most_open` sequences are open none is opened any more, and a document that would overfill a
sequence is cut where that is full. The same rule ends a task: the emptiest open sequence is dissolved and
its pieces are placed among the others, until one is left, which is cut at powers of two, so that there is no
padding. Every placement is made by the sum of squares, on tasks of any size.

Each task packs its own documents, in the order of the input and with numbers of its own; nothing is
shuffled. Defined cases: null or empty text is the end id alone; a text of any length is cut; repeated
rows are packed once each; an empty table gives no sequences; only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, stage_docs, task
from .tokens import encoder

#: Sequences that may be open at once: more cut fewer documents, and leave more to be dissolved at the end.
MOST_OPEN = 512
#: Tokens of emitted pieces that are held before they leave as one batch.
FLUSH_ROWS = 5000
#: Characters of the texts that are encoded at once.
CHUNK = 1 << 20


class LevelArray:
    """Open sequences by fill level, and the number of them at each level."""

    def __init__(self, size: int, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.held = 0

    def choose(self, n: int, cut: bool = False) -> int:
        """The level to put n tokens on; 0 opens a sequence. Ties go to the fullest. If they may be cut, too full a level will do and none is opened."""
        top = self.size - n
        count = self.count
        change = np.full(self.size, np.iinfo(np.int64).max)
        change[1 : top + 1] = 2 * count[n + 1 : self.size + 1] + 1  # the level reached has one more
        change[top] = 0  # full sequences aren't counted
        change[1 : top + 1] -= 2 * count[1 : top + 1] - 1  # the level left has one less
        if cut:
            change[top + 1 :] = 1 - 2 * count[top + 1 : self.size]
        change[1:][count[1 : self.size] == 0] = np.iinfo(np.int64).max
        change[0] = np.iinfo(np.int64).max if cut else 0 if not top else 2 * count[n] + 1
        return self.size - 1 - int(np.argmin(change[::-1]))

    def put(self, doc: int, start: int, ids: np.ndarray, total: int):
        """Place a piece, cut if need be; the sequences that it fills."""
        while len(ids):
            level = self.choose(len(ids), cut=self.held >= self.most_open)
            sequence = []
            if level:
                sequence = self.open[level].pop()
                self.count[level] -= 1
                self.held -= 1
            take = min(len(ids), self.size - level)
            sequence.append((doc, start, ids[:take], total))
            start, ids = start + take, ids[take:]
            if level + take == self.size:
                yield sequence
            else:
                self.open[level + take].append(sequence)
                self.count[level + take] += 1
                self.held += 1

    def finish(self):
        """The sequences filled by dissolving the emptiest open one again and again; what is left at last is yielded as it is."""
        self.most_open = 1
        while self.held > 1:
            level = int(np.flatnonzero(self.count)[0])
            self.count[level] -= 1
            self.held -= 1
            for piece in self.open[level].pop():
                yield from self.put(*piece)
        for level in np.flatnonzero(self.count).tolist():
            yield self.open[level].pop()


def powers(sequence: list) -> list[list]:
    """The pieces of a sequence dealt to sequences whose lengths are powers of two, the largest first."""
    left, out = sum(len(p[2]) for p in sequence), []
    rest = list(reversed(sequence))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        now = []
        while size:
            doc, start, ids, total = rest.pop()
            take = min(size, len(ids))
            now.append((doc, start, ids[:take], total))
            size -= take
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], total))
        out.append(now)
    return out


def sequences(documents, size: int, most_open: int = MOST_OPEN):
    """Sequences (lists of (doc_id, start, ids, doc_tokens)) of an iterable of (doc_id, ids with the end id)."""
    levels = LevelArray(size, most_open)
    for doc, ids in documents:
        total = len(ids)
        whole = total - total % size
        for start in range(0, whole, size):
            yield [(doc, start, ids[start : start + size], total)]
        if whole < total:
            yield from levels.put(doc, whole, ids[whole:].copy(), total)  # an open piece holds no more than itself
    for sequence in levels.finish():
        if sum(len(p[2]) for p in sequence) == size:
            yield sequence
        else:
            yield from powers(sequence)


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(path: str, size: int, end_id: int):
    def run(batches):
        enc, end = encoder(path), np.array([end_id], dtype="<u4")
        documents = ((i, np.concatenate((x, end))) for ids, texts in chunks(batches, CHUNK) for i, x in zip(ids, enc.ids_of(texts), strict=True))
        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 40
        for sequence in sequences(documents, size):
            offset = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))
                offset += len(ids)
            number += 1
            if len(rows) >= FLUSH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of packed documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return stage_docs(docs).mapInArrow(task(_pack(tokenizer, size, end_id), tokenizer), ", ".join(f"{f.name} long" for f in _SCHEMA))
