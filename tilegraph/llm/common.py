"""What the corpus operators share: tables, checkpoints, bounded broadcasts and vectorised hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.storage import bounded_broadcast, discard, hot_limit, join_by_key  # noqa: F401

#: Rows with texts that go to Python at a time.
TEXT_ROWS = 1000

_libc = ctypes.CDLL(None)
U64 = np.uint64
MASK64 = (1 << 64) - 1


def materialise(df: DataFrame) -> DataFrame:
    """df as a written table (storage.materialise()), with few texts on their way to Python at a time."""
    return storage.materialise(df, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Spark's reader opens it, so any file system serves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_docs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, text string, null text as empty), whatever else docs carries."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), on an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_STEP = U64(0x9E3779B97F4A7C15)
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * _STEP)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        ones = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=U64)
        ones[0] = 1
        have = _powers[kind] = np.cumprod(ones, dtype=U64)
    return have[:n]


def prefix_codes(codes: np.ndarray) -> np.ndarray:
    """h with h[i] a polynomial hash of codes[:i], so that span_hash() gives any run's hash."""
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * _power("up", len(codes)), out=out[1:])
    return out


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """prefix_codes() of bytes."""
    return prefix_codes(BYTE_CODES[raw])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of raw[start:end]; equal bytes give equal hashes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * _power("down", len(prefix))[start])


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case UTF-8: maximal runs of ASCII letters, digits and other characters beyond ASCII."""
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = _WORD[raw]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_kept: dict[str, object] = {}


def kept(name: str, make):
    """What this worker keeps from task to task under a name: make(name), the first time."""
    if name not in _kept:
        _kept[name] = make(name)
    return _kept[name]


def begin(keeps: str | None) -> None:
    """Let go of what tasks of another kind have kept: the workers of one operator serve the next one too."""
    if gone := [k for k in _kept if k != keeps]:
        for k in gone:
            del _kept[k]
        release()


def task(run, keeps: str | None = None):
    """run (of Arrow batches) as a task that finds no more than its own things kept, and leaves no unused memory behind."""

    def whole(batches):
        begin(keeps)
        yield from run(batches)
        release()

    return whole


def release() -> None:
    """Give memory that this worker no longer uses back to the machine: workers live on between tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def small(batches, rows: int = 512):
    """Arrow batches in parts of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def chunks(batches, size: int):
    """Lists of (doc_id, text) of some `size` characters, from Arrow batches with these two columns first."""
    ids, texts, held = [], [], 0
    for batch in small(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t) + 1
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class Words:
    """The hashed words of a list of texts, as flat arrays: word hash, document index, spans in the joined bytes."""

    def __init__(self, texts: list[str]):
        coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(c) + 1 for c in coded), dtype=np.int64, count=len(coded))
        self.doc_start = np.concatenate(([0], np.cumsum(sizes)))
        self.raw = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
        self.start, self.end = word_spans(self.raw)
        self.hash = span_hash(prefix_hash(self.raw), self.start, self.end)
        #: Words of document i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(self.bounds)

    def keys(self) -> list[bytes]:
        """A 128-bit digest of each text's words in their order; equal words give equal digests."""
        return [xxhash.xxh3_128_digest(self.hash[a:b].tobytes()) for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document index) of each run of k words; a shorter text with words has one shingle of all of them."""
        n = np.where(self.counts >= k, self.counts - k + 1, (self.counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(n)), n)
        first = np.repeat(self.bounds[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(self.counts, k)[doc]
        h = np.zeros(len(first), dtype=U64)
        for j in range(k):
            inside = j < length
            at = np.minimum(first + j, max(len(self.hash) - 1, 0))
            h = np.where(inside, mix64(h * U64(0x9FB21C651E98DF25) + self.hash[at]) if len(self.hash) else h, h)
        return h, doc


def int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
