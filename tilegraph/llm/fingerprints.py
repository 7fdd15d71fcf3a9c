"""MinHash fingerprints of documents: universal hash permutations over five-word shingles, banded and verified.

Permutation j sends a shingle's 64-bit code x to a_j * x + b_j modulo 2^64 (a_j odd; its high bits are universal), for
a whole batch of documents at a time, and keeps each document's least value. A fingerprint holds 16 bits of each
least value; two documents agree in a permutation with the probability of their shingle sets' Jaccard
similarity, so the share of agreeing permutations is the likeness of two fingerprints. Bands of the
permutations are joined in Spark, and what meets in a band is verified by the exact Jaccard similarity of whole texts.

with_next() compares each document with an edited text that ends in the beginning of the next document. Documents
are dealt out by ranges of doc_id, once; each task streams its range in order, and only the first and the last document
of a range travel again, to meet their neighbours.

Defined cases: null text is empty; texts without words share one fingerprint, of no shingle, and are in no class; texts of
one to four words have one shingle; rows of one doc_id follow each other by a digest of their text, rows without one
come first; the last document's next is the first, a single document's is itself; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash
from .bagminhash import BROADCAST_IDS, REGISTERS
from .common import U64, Words, bounded_broadcast, chunks, materialise, mix64, small, stage_docs, task

#: Characters of the texts that a task takes at a time; each comes with its edited form and the next text.
CHUNK = 1 << 18
#: Of permutation j: the odd factor and the summand.
_FACTOR = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SUMMAND = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def registers(words: Words) -> np.ndarray:
    """documents x permutations: 16 bits of the least value of each permutation over a document's shingles; one value for all without shingles."""
    shingles, doc = words.shingles()
    least = np.full((len(words.counts), REGISTERS), np.iinfo(np.uint64).max, dtype=U64)
    filled = np.flatnonzero(words.counts > 0)
    if len(filled):
        starts = np.searchsorted(doc, filled)
        for j in range(REGISTERS):
            least[filled, j] = np.minimum.reduceat(shingles * _FACTOR[j] + _SUMMAND[j], starts)
    return (mix64(least) >> U64(48)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the permutations in which fingerprints agree, by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters of the following one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_ROW = "doc_id long, n_chars long, edited_sha256 string, registers binary, edited_registers binary, near_edited double, near_next double, n_shingles long, words_key binary"
_EDGE = f"{_ROW}, part int, side string, text string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _rows(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of _ROW of documents that each come with the next one's text."""
    n, changed = len(ids), [edited(t, f) for t, f in zip(texts, following, strict=True)]
    words = Words([*texts, *changed, *following])
    found = registers(words)
    own, new, after = found[:n], found[n : 2 * n], found[2 * n :]
    shingles = np.where(words.counts[:n] >= 5, words.counts[:n] - 4, words.counts[:n] > 0)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [
        pa.array(ids, type=pa.int64()), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(sha), pa.array([r.tobytes() for r in own]), pa.array([r.tobytes() for r in new]),
        pa.array(likeness(own, new)), pa.array(likeness(own, after)), pa.array(shingles.astype(np.int64)), pa.array(words.keys()[:n]),
    ]


def _edge(part: int, side: str, doc_id, text: str) -> pa.RecordBatch:
    given = {"doc_id": doc_id, "part": part, "side": side, "text": text}
    return pa.RecordBatch.from_arrays([pa.array([given.get(c.split()[0])], type=t) for c, t in zip(_EDGE.split(", "), _EDGE_TYPES, strict=True)], names=[c.split()[0] for c in _EDGE.split(", ")])


_EDGE_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]] for c in _EDGE.split(", ")]


def _range(batches):
    """Rows of a range in order but for its last; its first and its last document as edges."""
    part, before = TaskContext.get().partitionId(), None
    for ids, texts in chunks(batches, CHUNK):
        if before is None:
            yield _edge(part, "first", ids[0], texts[0])
        else:
            ids, texts = [before[0], *ids], [before[1], *texts]
        before = ids[-1], texts[-1]
        if n := len(ids) - 1:
            cols = _rows(ids[:-1], texts[:-1], texts[1:])
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[c.split()[0] for c in _EDGE.split(", ")])
    if before is not None:
        yield _edge(part, "last", *before)


def _close(batches):
    for batch in small(batches, 16):
        yield pa.RecordBatch.from_arrays(_rows(*(batch.column(k).to_pylist() for k in range(3))), names=_NAMES)


def with_next(docs: DataFrame) -> DataFrame:
    """Per document, as a written table: the columns of _ROW, by its own text, the next document's and the edited one."""
    docs = stage_docs(docs)
    order = ["doc_id", F.xxhash64("text")]
    streamed = materialise(docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task(_range), _EDGE))
    edges = streamed.where("side is not null").select("part", "side", "doc_id", "text")
    parts = sorted(r["part"] for r in edges.where("side = 'first'").select("part").collect())  # one a range
    ring = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    firsts = edges.where("side = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    met = edges.where("side = 'last'").join(F.broadcast(ring), "part").join(firsts, "after").select("doc_id", "text", "following")
    return streamed.where("side is null").select(*_NAMES).unionByName(met.mapInArrow(task(_close), _ROW))


def fingerprint(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    class_id is the smallest doc_id that links of a Jaccard similarity of `threshold` or more reach from a document.
    """
    rows = with_next(docs)
    found = bagminhash.classes(rows.select("doc_id", "n_shingles", "words_key", "registers"), stage_docs(docs), threshold, bagminhash._set)
    moved = materialise(found.where("class_id <> doc_id").groupBy(F.col("doc_id").alias("__doc")).agg(F.min("class_id").alias("__class")))
    out = rows.join(bounded_broadcast(moved, BROADCAST_IDS), F.col("doc_id") == F.col("__doc"), "left")
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_chars", "edited_sha256", text("registers").alias("fingerprint"), text("edited_registers").alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("__class", "doc_id").alias("class_id"))
