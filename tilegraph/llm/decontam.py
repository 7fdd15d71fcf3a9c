"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of BLOCK words. Over the words of the benchmark (all other words have no
weight in any comparison) the corpus' blocks give document frequencies, and its TF-IDF passages a
randomised range sketch A'(A R), summed over the cluster; its Nystrom factor gives the leading singular
directions. Sliding windows of two and four blocks and the benchmark's items are projected onto them, and
items whose cosine with a window is high enough are candidates. So are, whatever their cosine, items with
enough of their answer words in a window, if these are rare in the corpus: rarer words of other items in the
same window hide no copy. A candidate is a match if the longest common subsequence of words covers enough of
the item and its answer words, the rarest ones, are there. Items that stand in a text word by word are found
by rolling hashes of their words, without any gate: no verbatim copy is lost, however common its words.

The benchmark is read in parts of about MOST_WORDS words, so that what each task holds (numbers and a row of RANK
for each different word) is bounded; for each part the corpus is scanned, never shuffled: only frequencies (one
row a term) and the sketch (one row a term) are. Every window of every text is compared.

Defined cases: null or empty text matches nothing; items of fewer than LEAST_WORDS words can't be told from
common speech and match word by word only, items without words never; repeated items match each; repeated rows of
a document are reported once by doc_id; a null doc_id is reported as null, and stays in the stage; an empty
corpus or benchmark gives an empty result; ties don't arise, all matches are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bounded_broadcast, chunks, materialise, mix64, prefix_codes, span_hash, task

BLOCK = 16
SKETCH, RANK = 48, 40
#: Words of the items that are sought in one scan: at most 8 million numbers of latent directions.
MOST_WORDS = 1 << 17
#: Shorter items are sought word by word only; longer ones by this many first words.
LEAST_WORDS = 8
#: Share of the corpus' blocks above which a word counts as a function word, without weight unless it is an answer word.
STOP = 0.03
COSINE, LCS, ANSWER = 0.3, 0.6, 0.5
CHUNK = 1 << 19
#: Cosines that are computed at once.
COMPARED = 1 << 22
#: Ids (8 bytes each) up to which documents are dropped by a broadcast; more are dropped by a shuffle.
BROADCAST_IDS = 1_000_000


class Vocabulary:
    """The hashed words of some benchmark items, numbered."""

    def __init__(self, texts: list[str]):
        words = Words(texts)
        self.terms, place = np.unique(words.hash, return_inverse=True)
        self.items = [place[a:b].astype(np.int64) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[(self.terms >> U64(20)).astype(np.int64) & ((1 << 18) - 1)] = True

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of the hashes that are terms."""
        at = np.flatnonzero(self.seen[(hashes >> U64(20)).view(np.int64) & ((1 << 18) - 1)])
        term = np.searchsorted(self.terms, hashes[at])
        same = self.terms[np.minimum(term, len(self.terms) - 1)] == hashes[at]
        return at[same], term[same]


def _blocks(words: Words, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each document and one more, block of each word); blocks do not cross documents."""
    n = -(-words.counts // size)
    first = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), words.counts)
    return first, first[doc] + (np.arange(len(doc)) - words.bounds[:-1][doc]) // size


def _frequencies(vocabulary: Vocabulary):
    def run(batches):
        df, blocks = np.zeros(len(vocabulary.terms), dtype=np.int64), 0
        for _, texts in chunks(batches, CHUNK):
            words = Words(texts)
            first, block = _blocks(words)
            at, term = vocabulary.number(words.hash)
            key = np.unique(block[at] * len(df) + term)
            df += np.bincount(key % len(df), minlength=len(df))
            blocks += int(first[-1])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], blocks))], names=["term", "n"])

    return run


def _rows(block, term, idf, size: int):
    """Sparse TF-IDF rows of unit length: (row, term, value), ordered by row."""
    key, count = np.unique(block * size + term, return_counts=True)
    row, col = key // size, key % size
    value = (1 + np.log(count)) * idf[col]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    norm = np.sqrt(np.add.reduceat(value * value, head)) if len(row) else value
    return row, col, value / np.repeat(norm, np.diff(np.append(head, len(row)))), head


def _sketch(vocabulary: Vocabulary, idf: np.ndarray, omega: np.ndarray):
    names = ["term", *(f"c{k}" for k in range(omega.shape[1]))]

    def run(batches):
        size = len(idf)
        total = np.zeros((size, omega.shape[1]))
        for _, texts in chunks(batches, CHUNK):
            words = Words(texts)
            _, block = _blocks(words, 2 * BLOCK)
            at, term = vocabulary.number(words.hash)
            told = idf[term] > 0
            at, term = at[told], term[told]
            if not len(at):
                continue
            row, col, value, head = _rows(block[at], term, idf, size)
            value = value.astype(np.float32)[:, None]
            projected = np.add.reduceat(value * omega[col], head, axis=0)
            back = value * np.repeat(projected, np.diff(np.append(head, len(row))), axis=0)
            by = np.argsort(col, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(col[by]) > 0))
            total[col[by][cut]] += np.add.reduceat(back[by], cut, axis=0)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(total.shape[1]))], names=names)

    return run


def latent(sketch: np.ndarray, omega: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading directions (terms x rank) of the positive matrix G with sketch = G omega."""
    shift = 1e-8 * max(np.linalg.norm(sketch), 1e-12)
    moved = sketch + shift * omega
    values, vectors = np.linalg.eigh((omega.T @ moved + moved.T @ omega) / 2)
    good = values > values[-1] * 1e-10
    root = moved @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Verbatim:
    """The items of a vocabulary by the hash of their first words, for copies word by word."""

    def __init__(self, items: list[np.ndarray]):
        self.size = np.asarray([len(x) for x in items], dtype=np.int64)
        some = np.flatnonzero(self.size)
        prefix = prefix_codes(self._codes(np.concatenate([*items, np.zeros(0, dtype=np.int64)])))
        start = np.cumsum(self.size) - self.size
        self.whole = span_hash(prefix, start, start + self.size)
        self.anchors = []
        for n in np.unique(np.minimum(self.size[some], LEAST_WORDS)).tolist():
            own = some[np.minimum(self.size[some], LEAST_WORDS) == n]
            head = span_hash(prefix, start[own], start[own] + n)
            by = np.argsort(head, kind="stable")
            keys, first, many = np.unique(head[by], return_index=True, return_counts=True)
            self.anchors.append((n, keys, first, many, own[by]))

    @staticmethod
    def _codes(numbers: np.ndarray) -> np.ndarray:
        return mix64(numbers.astype(U64) + U64(1))

    def find(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of each copy in numbered words; ends gives for each word where its document ends."""
        prefix = prefix_codes(self._codes(numbers))
        foreign = np.concatenate(([0], np.cumsum(numbers < 0)))
        at, item = [], []
        for n, keys, first, many, own in self.anchors:
            p = np.flatnonzero(foreign[n:] == foreign[: max(len(foreign) - n, 0)])  # n words of the vocabulary
            p = p[p + n <= ends[p]]
            h = span_hash(prefix, p, p + n)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            p, k = p[hit], k[hit]
            times = many[k]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            p, found = np.repeat(p, times), own[np.repeat(first[k], times) + within]
            full = p + self.size[found] <= ends[p]
            p, found = p[full], found[full]
            same = span_hash(prefix, p, p + self.size[found]) == self.whole[found]
            at.append(p[same])
            item.append(found[same])
        return np.concatenate([*at, np.zeros(0, dtype=np.int64)]), np.concatenate([*item, np.zeros(0, dtype=np.int64)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _answers(vocabulary: Vocabulary, idf: np.ndarray) -> dict[int, set[int]]:
    """The answer words, the rarest ones, of each item that is long enough to be sought."""
    usable = [k for k, x in enumerate(vocabulary.items) if len(x) >= LEAST_WORDS]
    return {k: set(sorted(set(vocabulary.items[k].tolist()), key=lambda t: (-idf[t], t))[: max(3, len(vocabulary.items[k]) // 4)]) for k in usable}


def _search(vocabulary: Vocabulary, ids: list[int], idf: np.ndarray, answers: dict[int, set[int]], rare: np.ndarray, directions: np.ndarray, cosine: float, least_lcs: float, least_answer: float):
    weights = (idf[:, None] * directions).astype(np.float32)
    size = len(idf)

    def project(items):
        row = np.repeat(np.arange(len(items)), [len(x) for x in items])
        key, count = np.unique(row * size + np.concatenate(items), return_counts=True)
        out = np.zeros((len(items), weights.shape[1]))
        np.add.at(out, key // size, (1 + np.log(count))[:, None] * weights[key % size])
        return _unit(out).astype(np.float32)

    usable = list(answers)
    # an item is sought in windows that hold all of it, wherever it begins: two blocks, or four
    groups = [(2, [k for k in usable if len(vocabulary.items[k]) <= BLOCK + 1]), (4, [k for k in usable if len(vocabulary.items[k]) > BLOCK + 1])]
    groups = [(n, ks, project([vocabulary.items[k] for k in ks])) for n, ks in groups if ks]
    # a chance meeting of rare answer words passes no later check, so these items are verified whatever the cosine
    rare_item = {k: all(rare[t] for t in a) for k, a in answers.items()}
    need = {k: max(1, int(np.ceil(least_answer * len(a)))) for k, a in answers.items()}
    # answer words to the items that need them
    pairs = sorted((t, k) for k, a in answers.items() for t in a)
    of_term = np.asarray([t for t, _ in pairs], dtype=np.int64)
    of_item = np.asarray([k for _, k in pairs], dtype=np.int64)
    first_of, n_of = np.searchsorted(of_term, np.arange(size)), np.bincount(of_term, minlength=size)

    def reach(k: int) -> int:
        """Words beside a window that the check of an item takes in."""
        n = len(vocabulary.items[k])
        return n if n > 3 * BLOCK else BLOCK // 2

    exact = Verbatim(vocabulary.items)
    itself = project(vocabulary.items)

    def verify(words, numbers, doc, a, b, k):
        a, b = max(a - reach(k), words.bounds[doc]), min(b + reach(k), words.bounds[doc + 1])
        seen = numbers[a:b]
        seen = seen[seen >= 0].tolist()
        held = len(answers[k] & set(seen))
        item = vocabulary.items[k]
        return (lcs(item.tolist(), seen) / len(item) if held >= need[k] else 0.0), held / len(answers[k])

    def run(batches):
        for doc_ids, texts in chunks(batches, CHUNK):
            words = Words(texts)
            first, block = _blocks(words)
            at, term = vocabulary.number(words.hash)
            if not len(at):
                continue
            numbers = np.full(len(words.hash), -1, dtype=np.int64)
            numbers[at] = term
            blocks = int(first[-1])
            # answer words by block, and by item and block
            answering = n_of[term] > 0
            rare_block, rare_term = block[at][answering], term[answering]
            n = n_of[rare_term]
            item = of_item[np.repeat(first_of[rare_term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            hit_key, hits = np.unique(item * blocks + np.repeat(rare_block, n), return_counts=True)
            hits = np.concatenate(([0], np.cumsum(hits)))
            answers_before = np.concatenate(([0], np.cumsum(np.bincount(rare_block, minlength=blocks))))
            copy_at, copied = exact.find(numbers, np.repeat(words.bounds[1:], words.counts))
            sums = np.zeros((blocks + 4, weights.shape[1]), dtype=np.float32)
            told = idf[term] > 0
            if told.any():
                at, term = at[told], term[told]
                cut = np.flatnonzero(np.append(True, np.diff(block[at]) > 0))
                sums[block[at][cut]] = np.add.reduceat(weights[term], cut, axis=0)
            hit_item, hit_block = hit_key // blocks, hit_key % blocks
            best: dict[tuple[int, int], tuple] = {}
            owner = np.repeat(np.arange(len(doc_ids)), np.diff(first))
            two = sums[:-1] + sums[1:]
            pair, one = np.unique(owner[block[copy_at]] * len(vocabulary.items) + copied, return_index=True)
            for d, k, p in zip((pair // len(vocabulary.items)).tolist(), copied[one].tolist(), copy_at[one].tolist(), strict=True):
                start = int(block[p])
                v = two[start] if len(vocabulary.items[k]) <= BLOCK + 1 else two[start] + two[start + 2]
                best[d, k] = 1.0, 1.0, float(v @ itself[k] / max(np.linalg.norm(v), 1e-12))
            for n, ks, items in groups:
                window = two[:blocks] if n == 2 else (two[:-2] + two[2:])[:blocks]
                # a window near a document's end takes in the next one's first blocks; the check below does not
                side = max(-(-reach(k) // BLOCK) for k in ks)
                lo, hi = np.maximum(np.arange(blocks) - side, 0), np.minimum(np.arange(blocks) + n + side, blocks)
                # where there are too few answer words for any item, no check can succeed
                live = np.flatnonzero(answers_before[hi] - answers_before[lo] >= min(need[k] for k in ks))
                ks = np.asarray(ks)
                wanted = np.asarray([need[k] for k in ks.tolist()])
                # (item, start) whose answer words suffice: the starts around a first answer word that enough others follow
                least = np.zeros(len(vocabulary.items), dtype=np.int64)
                least[ks] = [need[k] if rare_item[k] else 0 for k in ks.tolist()]
                span = n + 2 * side
                mine = np.flatnonzero(least[hit_item] > 0)
                follow = hits[np.searchsorted(hit_key, hit_key[mine] - hit_block[mine] + np.minimum(hit_block[mine] + span, blocks))] - hits[mine]
                mine = mine[follow >= least[hit_item[mine]]]
                start = (hit_block[mine][:, None] - side - n + 1 + np.arange(span)).ravel()
                item = np.repeat(hit_item[mine], span)
                inside = (start >= 0) & (start < blocks)
                key = np.unique(item[inside] * blocks + start[inside])
                item, start = key // blocks, key % blocks
                held = hits[np.searchsorted(hit_key, item * blocks + hi[start])] - hits[np.searchsorted(hit_key, item * blocks + lo[start])]
                sought = dict.fromkeys(key[held >= least[item]].tolist())
                for part in np.array_split(live, max(1, -(-len(live) * len(ks) // COMPARED))):
                    x, y = np.nonzero(_unit(window[part]) @ items.T >= cosine)
                    x = part[x]
                    key = ks[y] * blocks
                    held = hits[np.searchsorted(hit_key, key + hi[x])] - hits[np.searchsorted(hit_key, key + lo[x])]
                    kept = held >= wanted[y]
                    sought.update(dict.fromkeys((key + x)[kept].tolist()))
                for x in sought:
                    k, start = divmod(x, blocks)
                    doc = int(owner[start])
                    if best.get((doc, k), (0.0,))[0] == 1.0:
                        continue
                    a = words.bounds[doc] + (start - first[doc]) * BLOCK
                    shared, answer = verify(words, numbers, doc, a, a + n * BLOCK, k)
                    if shared >= least_lcs and answer >= least_answer:
                        v, w = window[start], items[np.searchsorted(ks, k)]
                        best[doc, k] = max(best.get((doc, k), ()), (shared, answer, float(v @ w / max(np.linalg.norm(v), 1e-12))))
            if best:
                keys, values = zip(*best.items(), strict=True)
                cols = [[doc_ids[d] for d, _ in keys], [ids[k] for _, k in keys], *zip(*values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "lcs", "answer", "cosine"])

    return run


_RESULT = "doc_id long, item_id long, lcs double, answer double, cosine double"


def _part(docs: DataFrame, items: list, cosine: float, least_lcs: float, least_answer: float) -> DataFrame:
    vocabulary = Vocabulary([r["text"] for r in items])
    size = len(vocabulary.terms)
    counts = {r["term"]: r["n"] for r in docs.mapInArrow(task(_frequencies(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word of the items
    df = np.asarray([counts.get(k, 0) for k in range(size)], dtype=float)
    idf = (np.log((counts.get(-1, 0) + 1) / (df + 1)) + 0.05) ** 2  # squared: the latent directions shall tell rare words apart
    answers = _answers(vocabulary, idf)
    # an item that leaks often makes its own words frequent: its answer words keep their weight
    told = np.zeros(size, dtype=bool)
    told[[t for a in answers.values() for t in a]] = True
    rare = df <= STOP * counts.get(-1, 0)
    idf[~told & ~rare] = 0.0
    omega = np.random.default_rng(7).standard_normal((size, min(SKETCH, size))).astype(np.float32)
    names = [f"c{k}" for k in range(omega.shape[1])]
    parts = docs.mapInArrow(task(_sketch(vocabulary, idf, omega)), ", ".join(["term long", *(f"{c} double" for c in names)]))
    summed = parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # a row for each word of the items
    sketch = np.zeros(omega.shape)
    if summed.num_rows:
        sketch[summed.column(0).to_numpy()] = np.column_stack([summed.column(c).to_numpy() for c in names])
    directions = latent(sketch, omega.astype(float))
    return docs.mapInArrow(task(_search(vocabulary, [r["item_id"] for r in items], idf, answers, rare, directions, cosine, least_lcs, least_answer)), _RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least_lcs: float = LCS, least_answer: float = ANSWER, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine) of each document and each benchmark item that it holds, if only in other words."""
    from .common import stage_docs

    docs = stage_docs(docs)
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // most_words))
    out = None
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()  # about most_words words
        if any(Words([r["text"]]).counts[0] for r in rows):
            found = _part(docs, rows, cosine, least_lcs, least_answer)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("lcs", "answer", "cosine")))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; columns stay as they are."""
    found = materialise(matches(docs, benchmark).select(F.col("doc_id").alias("__held")).distinct())
    held = bounded_broadcast(found, BROADCAST_IDS)
    return docs.join(held, docs["doc_id"] == held["__held"], "left_anti")
