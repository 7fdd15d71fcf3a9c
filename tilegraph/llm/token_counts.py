"""Token counts that follow edits: a segment tree of pre-token runs per document.

The leaves of a document's tree are runs of whole pre-tokens that begin after white space, where no
pre-token rule looks across; inner nodes hold sums of characters and tokens. An edit finds its leaves by
descending the character sums, takes in a neighbour where the edit joined it to what was beside it, encodes
that region anew and updates the sums above. The rest of the document is never encoded again. Under a tokenizer
whose pre-tokens hold white space, or whose rules aren't known, a document is one leaf.

Defined cases: null or empty text is one empty leaf and counts no tokens; edits are applied in order, each
to the text that the ones before it left; bounds beyond the text are cut to it; a null replacement
is empty; a null or empty edit list leaves the count as it is; a stretch without white space is one leaf
whatever its length, and each edit within it encodes it anew; repeated rows are counted once each; a null doc_id
stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, task
from .tokens import encoder

LEAF = 512
#: The size of a leaf that holds any document.
WHOLE = 1 << 62


def leaves(text: str, size: int = LEAF) -> list[str]:
    """text in runs of some `size` characters, each but the first beginning after white space."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        out.append(text[at:end])
        at = end
    return out or [""]


class PreTokenTree:
    """Sums of characters and tokens over a document's leaves."""

    def __init__(self, text: str, count, size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        self._build(leaves(text, size))

    def _build(self, parts: list[str], tokens: list[int] | None = None):
        self.leaf = parts
        self.width = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, part in enumerate(parts):
            self.chars[self.width + i] = len(part)
            self.tokens[self.width + i] = tokens[i] if tokens else self._tokens(part)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _tokens(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part)

    def _sum(self, i: int):
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position (the last one for the text's end), and where the leaf begins."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if position >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, replacement: str):
        """Replace the characters start:end."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, base = self.find(max(start - 1, 0))
        last, last_base = self.find(max(end - 1, start - 1, 0))
        region = "".join(self.leaf[first : last + 1])
        region = region[: start - base] + replacement + region[end - base :]
        before = next((i for i in range(first - 1, -1, -1) if self.leaf[i]), None)
        if before is not None and not self.leaf[before][-1].isspace():
            region, first = self.leaf[before] + region, before
        while region and not region[-1].isspace() or not region:  # what follows may now belong to the last pre-token
            after = next((i for i in range(last + 1, len(self.leaf)) if self.leaf[i]), None)
            if after is None:
                break
            region, last = region + self.leaf[after], after
        parts = leaves(region, self.size)
        if len(parts) <= last - first + 1:
            for k in range(first, last + 1):
                self._set(k, parts[k - first] if k - first < len(parts) else "")
        else:
            kept = self.tokens[self.width :]
            fresh = [self._tokens(p) for p in parts]
            tail = len(self.leaf)
            self._build(self.leaf[:first] + parts + self.leaf[last + 1 :], kept[:first] + fresh + kept[last + 1 : tail])

    def _set(self, k: int, part: str):
        if part == self.leaf[k]:
            return
        self.leaf[k] = part
        i = self.width + k
        self.chars[i], self.tokens[i] = len(part), self._tokens(part) if part else 0
        while i > 1:
            i //= 2
            self._sum(i)


def _count(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in small(batches):
            out = []
            for doc, text, edits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tree = PreTokenTree(text, enc.count, LEAF if enc.apart else WHOLE)
                before, tree.encoded = tree.total(), 0
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                out.append((doc, before, len(edits or ()), tree.total(), tree.encoded, tree.chars[1]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "chars_encoded_again", "n_chars_edited"])

    return run


EDITS = "array<struct<start:long,end:long,replacement:string>>"


def counts_after_edits(docs: DataFrame, edits: Column, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_edited, chars_encoded_again, n_chars_edited; edits is a column of type EDITS."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(task(_count(tokenizer), tokenizer), "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, chars_encoded_again long, n_chars_edited long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with an `edits` column made of the rows (doc_id, seq, start, end, replacement) of an edit log, in order of seq."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("replacement"))))
    return docs.join(listed, "doc_id", "left")


def trial_edits() -> Column:
    """Three edits of each document that depend on its doc_id and length only: a deletion, an insertion and a swap of words from the text itself."""
    size = F.length(F.coalesce(F.col("text"), F.lit("")))

    def place(k: int, limit: Column) -> Column:
        return F.pmod(F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(k)))), limit + 1)

    def piece(k: int, n: int) -> Column:
        return F.substr(F.coalesce(F.col("text"), F.lit("")), (place(k, size) + 1).cast("int"), F.lit(n))

    def edit(start: Column, end: Column, text: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), text.alias("replacement"))

    one, two, three = place(1, size), place(2, size), place(3, size)
    return F.array(edit(one, one + 25, F.lit("")), edit(two, two, piece(4, 30)), edit(three, three + 12, F.concat(F.lit(" "), piece(5, 12))))
