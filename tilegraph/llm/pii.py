"""PII by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are found by fixed patterns with validation. Together with secrets of
known shape they are the seeds of a bootstrap: every identifier-like string (one that holds a digit) of every
text is an instance; the three words or signs before it, and the two, with the sign after it, are its lexical
patterns. Over the graph of patterns and distinct instances Spark repeats two sums: a pattern is as trusted
as the share of its instances' trust (smoothed), an instance as the best of its patterns. Patterns that end up
trusted, with enough different instances, mark all their instances, whatever their shape, as new spans; base
spans always stay.

Instances are distinct strings, so copies of a text don't vouch for a pattern. All counts are combined before
each shuffle; the graph's tables hold hashes only; patterns and instances with very many edges are dealt out.
Rounds end after `rounds`, or when no trust changes.

Defined cases: null or empty text has no spans; base matches are leftmost, non-overlapping, per kind, and
failing matches are dropped without a retry; a discovered span that meets a base span or an earlier discovered
one is dropped; repeated rows are reported once each; a null doc_id stays null; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import BROADCAST_ROWS
from .common import hot_limit, join_by_key, materialise, small

KINDS = ("email", "ip", "card", "phone")
ROUNDS, TRUSTED, SUPPORT, SMOOTHING = 4, 0.8, 5, 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What ends an instance: a run of other characters that holds a digit, of six characters or more.
_STOPS = frozenset(" \t\r\n\x0b\x0c\"'`<>|()[]{},;=!?")
_STOP = re.compile("[" + re.escape("".join(sorted(_STOPS))) + "]")
_DIGIT = re.compile("[0-9]")
_CUE = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Secrets of known shape, the seeds beside the base entities.
_SECRET = re.compile(r"(?:(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, each sign looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0") or "0") < 4 and int(p) <= 255 for p in m[0].split("."))]
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def contexts(text: str):
    """(start, end, instance, patterns, seed kind or None) of the instances of a text."""
    base = {(a, b): k for k, a, b in base_spans(text)}
    b = 0
    while m := _DIGIT.search(text, b):
        a, done = m.start(), b
        while a > done and text[a - 1] not in _STOPS:
            a -= 1
        m = _STOP.search(text, m.end())
        b = next_ = m.start() if m else len(text)
        while b > a and text[b - 1] in ".:!?%#&*$":
            b -= 1
        if b - a < 6:
            b = next_
            continue
        left, right = text[max(0, a - 24) : a], text[b : b + 1]
        # the three, and the two, words or signs before it, and the sign after it
        words = _CUE.findall(left.lower())[-3:]
        after = "\x00" + (right if right and not right.isalnum() else "")
        kind = base.get((a, b)) or ("secret" if _SECRET.match(text, a, b) else None)
        yield a, b, text[a:b], tuple(" ".join(words[k:]) + after for k in range(max(1, len(words) - 1))), kind
        b = next_


def _signed(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


_EDGES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("pattern", pa.int64()), ("seed", pa.string())])
_BASE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string())])


def _row(doc_id, text: str) -> int:
    """Tells rows of one doc_id with unequal texts apart."""
    return _signed(f"{doc_id}:{len(text)}:{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}")


def _find_instances(batches):
    for batch in small(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list(contexts(text))
            row = _row(doc, text) if found else 0
            rows += [(doc, row, a, b, _signed(inst), _signed(pattern), kind) for a, b, inst, patterns, kind in found for pattern in patterns]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _EDGES, strict=True)], schema=_EDGES)


def _find_base(batches):
    for batch in small(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text)
            rows.append((doc, _row(doc, text), *(sum(k == kind for k, _, _ in spans) for kind in KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _BASE, strict=True)], schema=_BASE)


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, trusted: float = TRUSTED, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, trust): the patterns whose instances are, as far as the graph can tell, identifiers of that kind."""
    edges = materialise(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    wide = materialise(edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= support))
    hot_pattern = hot_limit(wide, "instances")
    edges = materialise(join_by_key(edges, wide, "pattern", "instances", hot_pattern).drop("instances"))
    seeds = materialise(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("degree")))
    hot_instance = hot_limit(seeds, "degree")
    trust = seeds.select("instance", "degree", F.col("seed").alias("kind"), F.col("seed").isNotNull().cast("double").alias("trust"))
    edges = edges.select("pattern", "instance")
    before = None
    for _ in range(rounds):
        held = join_by_key(edges, trust, "instance", "degree", hot_instance)
        by_kind = held.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("trust").alias("t"))
        all_n = by_kind.groupBy("pattern").agg(F.sum("n").alias("n"), F.max(F.struct(F.when(F.col("kind").isNull(), -1.0).otherwise(F.col("t")).alias("t"), F.coalesce("kind", F.lit("")).alias("kind"))).alias("best"))
        patterns = materialise(all_n.select("pattern", F.col("best.kind").alias("kind"), (F.greatest(F.col("best.t"), F.lit(0.0)) / (F.col("n") + SMOOTHING)).alias("trust"), F.col("n").alias("instances")))
        state = patterns.agg(F.count("*"), F.round(F.sum("trust"), 9)).first()
        if state == before:
            break
        before = state
        reached = join_by_key(edges, patterns.where((F.col("trust") > 0.5) & (F.col("kind") != "")), "pattern", "instances", hot_pattern).groupBy("instance").agg(F.max(F.struct("trust", "kind")).alias("best"))
        trust = seeds.join(reached, "instance", "left").select("instance", "degree", F.coalesce("seed", "best.kind").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("best.trust", F.lit(0.0))).alias("trust"))
        trust = materialise(trust)
    return patterns.where((F.col("trust") >= trusted) & (F.col("instances") >= support) & (F.col("kind") != "")).select("pattern", "kind", "trust")


def _apart(base: list[tuple[str, int, int]], more) -> list[tuple[str, int, int]]:
    """Those of `more`, by start, that meet neither a base span nor an earlier one of their own."""
    lows, highs = [], []  # the base spans' union
    for a, b in sorted((a, b) for _, a, b in base):
        if highs and a <= highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    out, end = [], 0
    for s in sorted(more, key=lambda s: (s["start"], s["end"], s["kind"])):
        k = bisect_left(lows, s["end"]) - 1  # the last that begins before this one ends
        if s["start"] >= end and (k < 0 or highs[k] <= s["start"]):
            out.append((s["kind"], s["start"], s["end"]))
            end = s["end"]
    return out


def _merge(batches):
    for batch in small(batches):
        out = []
        for doc, *counts, base, more in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
            spans += _apart(spans, more or ())
            rank = {k: i for i, k in enumerate(KINDS)}
            spans.sort(key=lambda s: (rank.get(s[0], len(rank)), s[0], s[1], s[2]))
            out.append((doc, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), len(spans) - sum(counts), len(spans)))
        cols = list(zip(*out, strict=True)) or [()] * 9
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_discovered", "n_spans"])


def extract(docs: DataFrame, rounds: int = ROUNDS, trusted: float = TRUSTED, support: int = SUPPORT) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans."""
    from .common import stage_docs

    docs = stage_docs(docs)
    found = materialise(docs.mapInArrow(_find_instances, "doc_id long, row long, start long, end long, instance long, pattern long, seed string"))
    patterns = materialise(trusted_patterns(found, rounds, trusted, support))
    if patterns.count() <= BROADCAST_ROWS:
        marked = found.join(F.broadcast(patterns), "pattern")
    else:
        counted = found.groupBy("pattern").agg(F.count("*").alias("rows")).join(patterns, "pattern")
        marked = join_by_key(found, materialise(counted), "pattern", "rows")
    more = marked.groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    base = docs.mapInArrow(_find_base, "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string")
    both = base.join(more, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    both = both.select("doc_id", *(f"n_{k}" for k in KINDS), "base", "more")
    return both.mapInArrow(_merge, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_discovered long, n_spans long")
