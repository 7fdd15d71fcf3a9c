"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into symbols (insult, threat, target, negation, report, clause end); four
grammar transducers, each a small weighted automaton, are composed into one: negation and reported speech
weaken the insult or threat that they govern, a target beside an insult strengthens it, and a threat
counts only with a target. Composition adds weights (log scale); its states are made as they are first met.
Matched clauses are scored, not isolated words, and a logistic layer turns a document's clause scores into
a number from 0 to 1.

The insult arcs (word beginnings and whole words, with their weights; MOST_ARCS of the strongest) and the
logistic layer are learned from a bounded sample of labelled documents: the `sample` rows of the smallest
hash, a documented parameter that does not grow with the corpus; of a sampled text beyond LEARNED_CHARS evenly
spaced parts are learned from. Scoring reads every whole text, and clauses of any length. Scores depend on the
text alone.

Defined cases: null or empty text scores as a text without matches; a text without clause ends is one clause;
unlabelled rows are scored and never learned from; of unequal labels of one doc_id the largest holds; with no
labels, or labels of one kind, nothing is learned and the built-in threat grammar scores alone; repeated rows
score alike; a null doc_id stays null and is not held out; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, release, small, task

SAMPLE = 8000
#: Characters of a sampled text that are learned from: of longer ones, evenly spaced parts of PART characters.
LEARNED_CHARS, PART = 50_000, 1_000
THRESHOLD = 0.7
#: Lower confidence bound (in standard errors) of an arc's log rate ratio, and the least it may be.
ERRORS, LEAST = 2.33, 0.7
MOST_ARCS = 4000
SHORTEST, LONGEST = 3, 10

# Word classes of the grammar (English, French, German, Spanish).
TARGETS = "you your yourself he him she her they them their tu toi vous ton votre il elle ils elles du dich dir ihr euch sie er usted ustedes él ella ellos ellas".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't ne pas jamais aucun nicht nie kein keine nunca jamás tampoco".split()
REPORTS = "said says wrote writes quoted claims claimed called reported dit disait écrit sagte schrieb behauptet dijo dice escribió afirmó".split()
THREATS = "kill hurt destroy punch stab shoot beat tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_ENDS = ".!?;:\n"
_CLAUSE_END = re.compile(f"[{_CLAUSE_ENDS}]")


class Transducer:
    """step(state, symbol) gives (state, symbol, log weight); the start state is 0."""

    def __init__(self, step):
        self.step = step

    def compose(self, after: Transducer) -> Transducer:
        """This transducer's output read by `after`; pair states get a number when first reached."""
        pairs, numbers, arcs = [(0, 0)], {(0, 0): 0}, {}

        def step(state: int, symbol: str):
            if (state, symbol) not in arcs:
                p, q = pairs[state]
                p, middle, v = self.step(p, symbol)
                q, out, w = after.step(q, middle)
                if (p, q) not in numbers:
                    numbers[p, q] = len(pairs)
                    pairs.append((p, q))
                arcs[state, symbol] = numbers[p, q], out, v + w
            return arcs[state, symbol]

        return Transducer(step)


def _near(cue: str, on: tuple[str, ...], reach: int, weight: float, out=None) -> Transducer:
    """Symbols in `on` at most `reach` words after a cue carry `weight` (and become out)."""

    def step(state, symbol):
        if symbol == cue:
            return reach, symbol, 0.0
        if symbol == "end":
            return 0, symbol, 0.0
        if symbol in on and state:
            return state - 1, out or symbol, weight
        return max(state - 1, 0), symbol, 0.0

    return Transducer(step)


def _clause(cue: str, on: tuple[str, ...], weight: float) -> Transducer:
    """Symbols in `on` after a cue, up to the clause's end, carry `weight`."""

    def step(state, symbol):
        if symbol == "end":
            return 0, symbol, 0.0
        if symbol == cue:
            return 1, symbol, 0.0
        return state, symbol, weight if state and symbol in on else 0.0

    return Transducer(step)


def grammar() -> Transducer:
    """Negation, reported speech, targets of insults and targets of threats, composed."""
    negation = _near("negation", ("insult", "threat"), 3, math.log(0.3))
    report = _clause("report", ("insult", "threat"), math.log(0.6))
    aimed = _near("target", ("insult",), 3, math.log(1.25))
    threat = _near("threat", ("target",), 4, 0.0, out="threatened")
    return negation.compose(report).compose(aimed).compose(threat)


class Scorer:
    """The composed grammar over a lexicon; features(text) is what the logistic layer sees."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs = arcs
        self.cues = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in words}
        self.grammar = grammar()
        self.search = ahocorasick.Automaton()
        for word in {*arcs, *(w + "$" for w in THREATS)}:
            self.search.add_word(word.rstrip("$"), word.rstrip("$"))
        if len(self.search):
            self.search.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of a word: the strongest arc that it follows."""
        found = [self.arcs.get(word[:n], 0.0) for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
        return max([self.arcs.get(word + "$", 0.0), *found])

    def clause(self, words: Iterable[str], seen: Counter) -> float:
        """Score of one clause; a word that the text has had n times before counts for one (n + 1)-th."""
        total, state = 0.0, 0
        for word in words:
            cue = self.cues.get(word)
            weight = 0.0 if cue else self.insult(word)
            symbol = cue or ("insult" if weight else "other")
            state, out, logged = self.grammar.step(state, symbol)
            if out == "insult":
                seen[word] += 1
                total += weight * math.exp(logged) / seen[word]
            elif out == "threatened":
                total += 3.0 * math.exp(logged)
        return total

    def features(self, text: str) -> tuple[float, float, float, float]:
        """(sum of clause scores, number of matched clauses, largest clause score, words) of a text."""
        low = text.lower()
        n_words = low.count(" ") + low.count("\n") + 1
        total = best = 0.0
        matched, done, seen = 0, 0, Counter()
        if len(self.search):
            for end, word in self.search.iter(low):
                start = end - len(word) + 1
                if start < done or (start and (low[start - 1].isalpha() or low[start - 1] == "'")):
                    continue
                a = max(done, 1 + max(low.rfind(c, done, start) for c in _CLAUSE_ENDS))
                stop = _CLAUSE_END.search(low, end + 1)
                b = stop.start() if stop else len(low)
                score = self.clause((m[0] for m in _WORDS.finditer(low, a, b)), seen)
                done = b
                if score > 0:
                    total, matched, best = total + score, matched + 1, max(best, score)
        return total, matched, best, n_words


def _design(features: np.ndarray) -> np.ndarray:
    total, matched, best, n = features.T
    return np.column_stack((np.ones(len(n)), np.log1p(total), np.log1p(matched), np.log1p(best), np.log1p(200.0 * total / n), np.log1p(200.0 * matched / n), matched == 0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Tally:
    """By label: words in all, occurrences of each word beginning and whole word ("word$"), and texts that hold it."""

    def __init__(self):
        self.words = [1, 1]
        self.counts: list[dict] = [defaultdict(int), defaultdict(int)]
        self.held: list[dict] = [defaultdict(int), defaultdict(int)]

    def copy(self) -> Tally:
        out = Tally()
        out.words, out.counts, out.held = list(self.words), [dict(c) for c in self.counts], [dict(h) for h in self.held]
        return out

    def add(self, text: str, label: int) -> None:
        bag = Counter(_WORDS.findall(text.lower()))
        self.words[label] += sum(bag.values())
        features: dict[str, int] = defaultdict(int)
        for word, n in bag.items():
            features[word + "$"] += n
            for size in range(SHORTEST + 1, min(len(word), LONGEST) + 1):
                features[word[:size]] += n
        counts, held = self.counts[label], self.held[label]
        for f, n in features.items():
            counts[f] += n
            held[f] += 1


def arcs_of(tally: Tally, less: Tally | None = None) -> dict[str, float]:
    """Features whose rate in toxic texts is surely higher, with the log of the ratio; `less` is taken off the tally first."""

    def rest(whole, part, f):
        return whole.get(f, 0) - (part.get(f, 0) if part is not None else 0)

    counts, held, words = ((getattr(tally, k), getattr(less, k) if less else (None, None)) for k in ("counts", "held", "words"))
    total = [words[0][k] - (words[1][k] - 1 if less else 0) for k in (0, 1)]
    arcs: dict[str, float] = {}
    for f in counts[0][1]:
        toxic = rest(held[0][1], held[1][1], f)
        if toxic < 5:
            continue
        ratio = math.log((rest(counts[0][1], counts[1][1], f) + 0.5) / total[1]) - math.log((rest(counts[0][0], counts[1][0], f) + 0.5) / total[0])
        if ratio - ERRORS * math.sqrt(1 / (toxic + 0.5) + 1 / (rest(held[0][0], held[1][0], f) + 0.5)) >= LEAST:
            arcs[f] = ratio
    for f in list(arcs):  # an arc that a shorter one says as strongly is not needed
        stem = f.rstrip("$")
        if any(arcs.get(stem[:n], 0.0) >= arcs[f] - 0.2 for n in range(SHORTEST, len(stem) + (f != stem)) if stem[:n] != f):
            del arcs[f]
    return dict(sorted(arcs.items(), key=lambda x: (-x[1], x[0]))[:MOST_ARCS])


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def _excerpt(text: Column) -> Column:
    """text, or of one beyond LEARNED_CHARS evenly spaced parts; the first and the last word of a part are lost with its edges."""
    parts = LEARNED_CHARS // PART
    step = (F.length(text) - PART) / (parts - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.floor(k * step).cast("int") + 1)
    cut = F.array_join(F.transform(at, lambda k: F.regexp_replace(F.substring(text, k, F.lit(PART)), r"^\S*|\S*$", "")), "\n")
    return F.when(F.coalesce(F.length(text), F.lit(0)) <= LEARNED_CHARS, text).otherwise(cut)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """(arcs, logistic weights) from at most `sample` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 1)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", _excerpt(F.col("text")).alias("text"), "toxic")
    rows = texts.orderBy("doc_id", "text").limit(sample).collect()  # bounded by `sample` and LEARNED_CHARS
    pairs = [(r["text"] or "", int(r["toxic"] > 0)) for r in rows]
    tally = Tally()
    for text, label in pairs[0::2]:
        tally.add(text, label)
    half = arcs_of(tally)
    first = tally.copy()
    for text, label in pairs[1::2]:
        tally.add(text, label)
    arcs = arcs_of(tally)
    if not arcs or len({y for _, y in pairs}) < 2:
        return arcs, np.array([-3.0, 1.5, 0.5, 0.5, 0.5, 0.0, 0.0])
    # arcs of one half, features of the other: arcs must not be judged on the evidence that they are from
    halves = [(half, pairs[1::2]), (arcs_of(tally, first), pairs[0::2])]
    if all(a for a, _ in halves) and len(pairs) >= 400:
        x = [Scorer(a).features(t) for a, part in halves for t, _ in part]
        y = [label for _, part in halves for _, label in part]
    else:
        scorer = Scorer(arcs)
        x, y = [scorer.features(t) for t, _ in pairs], [label for _, label in pairs]
    return arcs, _logistic(_design(np.asarray(x, dtype=float)), np.asarray(y, dtype=float))


def _score(arcs: dict[str, float], weights: np.ndarray):
    def run(batches):
        scorer = Scorer(arcs)
        for batch in small(batches):
            x = np.asarray([scorer.features(t or "") for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 1].astype(np.int64)), pa.array(x[:, 0])], names=["doc_id", "score", "n_clauses", "clause_score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_clauses, clause_score."""
    arcs, weights = learn(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(_score(arcs, weights)), "doc_id long, score double, n_clauses long, clause_score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses", "clause_score")


def _probability(arcs: dict[str, float], weights: np.ndarray):
    """A column function of a text: texts go to Python, one number a text comes back, the rest of a row stays where it is."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin(None)
        scorer = Scorer(arcs)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 512):
                x = np.asarray([scorer.features(t or "") for t in batch[at : at + 512].to_pylist()], dtype=float).reshape(-1, 4)
                out.append(1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30))))
            yield pa.array(np.concatenate([*out, []]))
        release()

    return F.arrow_udf(run, "double")


def stage(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without those that score `threshold` or more; columns stay as they are."""
    probability = _probability(*learn(docs, labels, sample))
    return docs.where(probability(F.col("text").cast("string")) < threshold)
