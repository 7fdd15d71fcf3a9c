"""Exact token ids at the speed of a lookup: each pre-token is encoded once and remembered.

The vocabulary's own rules (normaliser, pre-token pattern) are applied by the tokenizers library to any
text with characters beyond the fast set; texts of plain characters are split with the same pattern here and
each distinct pre-token goes to the library once. Results are equal by construction, as a pre-token's
ids do not depend on its neighbours.

That holds for files with RULES, whose words end in a mark and whose white space is dropped. The file is asked: under
any other rules each text goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: What a file must say of its normaliser and its pre-tokens for the split below to be the same (fixed values).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters for which the split below, NFC and lower-casing agree with the library: ASCII and composed Latin-1 letters.
_FAST = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Texts whose full stops and commas can stand by themselves (see _spread): most prose.
_PLAIN = re.compile(r"[\t\n\r A-Za-z0-9.,À-ÖØ-öø-ÿ]*\Z")
#: Runs between blanks and pre-tokens whose ids a worker remembers, twice over: those met lately, and those before them.
MOST_KEPT = 500_000
#: Marks of runs that were met once: only what is met again is remembered (all marks go when a quarter of them may be set).
MARKS = 1 << 22


def _spread(text: str) -> str | None:
    """Lower-case text whose runs between blanks no pre-token reaches beyond, or None where the library has to look at the whole.

    In prose without other signs, full stops and commas that do not touch are pre-tokens of their own: set
    apart from their words they leave far fewer different runs.
    """
    if _PLAIN.match(text):
        low = text.lower()
        if not (".." in low or ",," in low or ".," in low or ",." in low):
            return low.replace(".", " . ").replace(",", " , ")
        return low
    return None if "<|" in text or not _FAST.match(text) else text.lower()


class Encoder:
    """Ids of texts under one tokenizer file; with exact(text) as the plain way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part; threads beneath them only contend
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")) and said.get("truncation") is None and said.get("padding") is None
        #: Whether no pre-token looks beyond white space, and the split here is the file's own.
        self.apart = plain and all(said[k] == v for k, v in RULES.items()) and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
        self.apart &= all(t["content"].startswith("<|") for t in said.get("added_tokens") or [])
        #: Little-endian 32-bit ids by run between blanks, a pre-token being a run of its own.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.met, self.marked = bytearray(MARKS), 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def exact(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        """The ids of some pre-tokens."""
        if not new:
            return {}
        # many pre-tokens with blanks between cost far less than one call each; ids that close a word tell them apart
        parts = [" ".join(new[k : k + 500]) for k in range(0, len(new), 500)]
        ids = np.concatenate([np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(new):
            raw, cuts = ids.tobytes(), (ends * 4).tolist()
            return dict(zip(new, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        return {p: np.asarray(self.exact(p), dtype="<u4").tobytes() for p in new}

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs between blanks: those of their pre-tokens, put together. What was met before is remembered."""
        mixed = [(r, _SPLIT.findall(r)) for r in runs if not r.isalpha()]
        pieces = {r for r in runs if r.isalpha()}.union(*(p for _, p in mixed)).difference(self.known)
        new, known = self._encoded(list(pieces)), self.known
        new.update([(r, b"".join([new[x] if x in new else known[x] for x in p])) for r, p in mixed])
        if self.marked > MARKS // 4:
            self.met, self.marked = bytearray(MARKS), 0
        met, before = self.met, len(known)
        for run, ids in new.items():
            at = hash(run) % MARKS
            if met[at]:
                known[run] = ids
            else:
                met[at] = 1
        self.marked += len(new) - (len(known) - before)
        return new

    def _found(self, runs: list[str]) -> list[bytes]:
        """The ids of each of some runs. Once many are known, those that are not met again are forgotten."""
        if len(self.known) > MOST_KEPT:
            self.known, self.older = {"": b""}, self.known
        found = list(map(self.known.get, runs))
        if None in found:
            new = [r for r, ids in zip(runs, found, strict=True) if ids is None]
            self.known.update((r, self.older[r]) for r in new if r in self.older)
            late = self._learn([r for r in new if r not in self.known])
            found = [ids if ids is not None else late[r] if r in late else self.known[r] for r, ids in zip(runs, found, strict=True)]
        return found

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Runs are split and numbered in columns; the large table is asked once for each different one."""
        if not self.apart:
            return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ready = [_spread(t) for t in texts]
        runs = pc.utf8_split_whitespace(pa.array([t for t in ready if t is not None], pa.large_string()))
        coded = runs.values.dictionary_encode()
        found = self._found(coded.dictionary.to_pylist())
        known = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        code = coded.indices.to_numpy()
        many = size[code]
        before = np.concatenate(([0], np.cumsum(many)))
        ids = known[np.repeat((np.cumsum(size) - size)[code] - before[:-1], many) + np.arange(before[-1])]
        bounds = before[runs.offsets.to_numpy()].tolist()
        spans = zip(bounds[:-1], bounds[1:], strict=True)
        return [np.asarray(self.exact(t), dtype="<u4") if r is None else ids[slice(*next(spans))] for t, r in zip(texts, ready, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, which may be a short one."""
        ready = _spread(text) if self.apart else None
        return np.asarray(self.exact(text), dtype="<u4") if ready is None else np.frombuffer(b"".join(self._found(ready.split())), dtype="<u4")

    def count(self, text: str) -> int:
        return len(self.ids(text))


def encoder(path: str) -> Encoder:
    """One encoder of a worker process for each tokenizer file, until the worker does other work."""
    return kept(path, Encoder)
