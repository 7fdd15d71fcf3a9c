"""Toxicity, packing, token counts, PII, licenses and decontamination against brute force and worked cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import docs_of, prose
from tilegraph.llm import decontam, licenses, packing, pii, queries, token_counts, toxicity
from tilegraph.llm.tokens import Encoder, encoder

# ---------------------------------------------------------------- toxicity


def labelled(spark, n=900):
    rng = random.Random(8)
    bad = ["grumbo", "snarfel", "dweezle", "plonk"]
    texts, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randint(15, 80)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "ish"]))
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_generalises(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    staged = toxicity.stage(docs, labels)
    assert staged.columns == docs.columns and staged.count() == sum(not r["predicted"] for r in rows.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(toxicity.score(docs, labels)) == key(toxicity.score(docs, flipped))


def test_toxicity_edges(spark):
    docs = docs_of(spark, [None, "", "hello there", "I will kill you."])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, none).orderBy("doc_id").collect()
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"] < rows[3]["score"]
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_grammar_weighs_clauses():
    s = toxicity.Scorer({"plonk": 4.0})
    total = lambda text: s.features(text)[0]
    plain = total("what a plonk")
    assert total("not a plonk") == pytest.approx(0.3 * plain)
    assert total("he said: fine. what a plonk") == pytest.approx(plain)
    assert total("the man said what a plonk") == pytest.approx(0.6 * plain)
    assert total("you plonk") == pytest.approx(1.25 * plain)
    assert total("they kill time") == 0 and total("i kill you") > 0
    assert total("xplonk") == 0 and total("plonkish") == plain
    assert total("plonk plonk") == pytest.approx(plain * 1.5)


def clause_by_rules(words, arcs):
    """Score of one clause by the rules in words, without automata: what stands at most so many words before, and so on."""
    cues = {w: c for c, listed in (("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("threat", toxicity.THREATS)) for w in listed}
    symbols = [cues.get(w) or ("insult" if w in arcs else "other") for w in words]
    total, seen = 0.0, {}
    # a cue works on the words after it until its reach is spent, and anew from the next cue of its kind
    last = {c: None for c in ("negation", "target", "threat")}
    reported = False
    for k, (word, symbol) in enumerate(zip(words, symbols, strict=True)):
        near = lambda cue, reach, k=k: last[cue] is not None and k - last[cue] <= reach
        if symbol == "insult":
            factor = (0.3 if near("negation", 3) else 1) * (0.6 if reported else 1) * (1.25 if near("target", 3) else 1)
            seen[word] = seen.get(word, 0) + 1
            total += arcs[word] * factor / seen[word]
        if symbol == "target" and near("threat", 4):
            total += 3.0
        if symbol in last:
            last[symbol] = k
        reported |= symbol == "report"
    return total


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["plonk", "grumbo", "you", "him", "not", "never", "said", "kill", "hurt", "tree", "is", "a"]), max_size=14))
def test_composed_transducers_follow_the_rules(words):
    arcs = {"plonk": 2.0, "grumbo": 1.5}
    got = toxicity.Scorer(arcs).clause(words, toxicity.Counter())
    assert got == pytest.approx(clause_by_rules(words, arcs))


def test_clauses_of_any_length():
    s = toxicity.Scorer({"plonk": 4.0})
    far = "tree " * 2000
    plain = s.features("what a plonk")[0]
    assert s.features("the man said " + far + "what a plonk")[0] == pytest.approx(0.6 * plain)
    assert s.features(far + "the man said. " + far + "what a plonk")[0] == pytest.approx(plain)
    assert s.features("you " * 300_000 + "plonk")[:2] == (pytest.approx(1.25 * plain), 1)


def test_long_texts_are_learned_from_in_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNED_CHARS", 400)
    monkeypatch.setattr(toxicity, "PART", 40)
    texts = ["short text", None, " ".join(f"w{k}" for k in range(1000))]
    rows = docs_of(spark, texts).select(toxicity._excerpt(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in rows[:2]] == texts[:2] and len(rows[2]["t"]) <= 410
    words = [int(w[1:]) for w in rows[2]["t"].split()]
    assert set(words) <= set(range(1000)) and words[0] < 20 and words[-1] > 980 and len(words) > 50
    docs, labels = labelled(spark, 300)
    clash = docs.withColumns({c: F.lit("x") for c in ("toxic", "score", "predicted", "held_out")})
    assert toxicity.score(clash, labels).count() == 300


# ---------------------------------------------------------------- tokens and packing

PIECES = ["Hello, world's  best!", "l'été DÉJÀ-vu 123 4.5", "naïve\tcafé\n\nit'll we've I'd", "日本語 текст ñandú", "a_b __x__ _", "<|endoftext|> x", "ß ẞ İ ﬁ é", "", "!?…", "it's'st", " x y", "😀 ok"]


@pytest.mark.parametrize("text", PIECES)
def test_ids_equal_the_library(text):
    e = encoder(queries.TOKENIZER)
    assert e.ids(text).tolist() == e.exact(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ éÉñßþÿ'sStdmrevl019.,_-!<|> \n\tÀØ÷×ªº²µ"), max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    e = encoder(queries.TOKENIZER)
    assert e.ids(text).tolist() == e.exact(text)


def check_packing(documents, size, most_open=packing.MOST_OPEN):
    pieces, full = {}, 0
    sequences = list(packing.sequences(iter(documents), size, most_open))
    for seq in sequences:
        n = sum(len(p[2]) for p in seq)
        assert n == size or n & (n - 1) == 0
        assert n <= size and all(len(p[2]) for p in seq)
        full += n == size
        for doc, start, ids, total in seq:
            assert total == len(documents[doc][1])
            pieces.setdefault(doc, []).append((start, ids))
    for doc, ids in documents:
        parts = sorted(pieces[doc], key=lambda p: p[0])
        assert np.concatenate([p for _, p in parts]).tolist() == ids.tolist()
        assert [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts[:-1])]).tolist()
    return len(sequences) - full


def test_other_tokenizers(spark):
    """A cased byte-level vocabulary: ids, counts after edits and packed pieces are those of its own rules."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    e = Encoder(path)
    texts = ["Hello World, the Quick brown fox", "a  b\n\n c", "", "É é  x ", "It's 12.5", " lead", "<|endoftext|> x", "Plain words here. " * 90]
    assert not e.apart and encoder(queries.TOKENIZER).apart
    assert [x.tolist() for x in e.ids_of(texts)] == [e.exact(t) for t in texts] == [e.ids(t).tolist() for t in texts]
    assert len(e.ids(texts[0])) != len(encoder(queries.TOKENIZER).ids(texts[0])) or e.ids(texts[0]).tolist() != encoder(queries.TOKENIZER).ids(texts[0]).tolist()
    docs = docs_of(spark, texts)
    edits = F.expr("array(struct(2L AS start, 4L AS end, ' Q' AS replacement), struct(700L AS start, 701L AS end, '' AS replacement))")
    for r in token_counts.counts_after_edits(docs, edits.cast(token_counts.EDITS), path).collect():
        text = texts[r["doc_id"]]
        after = text[:2] + " Q" + text[4:] if len(text) > 2 else text + " Q"
        after = after[:700] + after[701:]
        assert (r["n_tokens"], r["n_tokens_edited"]) == (len(e.exact(text)), len(e.exact(after)))
    rows = packing.pack(docs, path).collect()
    assert all(r["doc_tokens"] == len(e.exact(texts[r["doc_id"]])) + 1 for r in rows) and sum(r["length"] for r in rows) == sum(len(e.exact(t)) + 1 for t in texts)



@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([16, 32]))
def test_packing_keeps_all_ids(sizes, size):
    assert check_packing([(k, np.arange(n, dtype="<u4")) for k, n in enumerate(sizes)], size) <= size.bit_length()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=200), st.integers(1, 9))
def test_packing_cuts_what_would_open_too_many(sizes, most_open):
    check_packing([(k, np.arange(n, dtype="<u4")) for k, n in enumerate(sizes)], 32, most_open)


@pytest.mark.parametrize("cut", [False, True])
def test_choice_minimises_the_sum_of_squares(cut):
    rng = random.Random(4)
    levels = packing.LevelArray(16, 10**9)
    for k in range(400):
        n = rng.randint(1, 15)

        def cost(level, n=n):
            c = levels.count.copy()
            if level:
                c[level] -= 1
            if level + n < 16:
                c[level + n] += 1
            return int((c[1:16] ** 2).sum())

        now = cut and levels.held > 0 and k % 2
        ways = [lv for lv in range(16) if (levels.count[lv] if lv else not now) and (now or lv + n <= 16)]
        pick = levels.choose(n, cut=bool(now))
        assert pick in ways and cost(pick) == min(map(cost, ways))
        assert not [lv for lv in ways if lv > pick and cost(lv) == cost(pick)]
        list(levels.put(0, 0, np.zeros(n), n))


def test_packed_query(spark, sf_dir):
    rows = queries.queries()["op5_packing"](spark, sf_dir).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    e = Encoder(queries.TOKENIZER)
    ids = {k: np.asarray([*e.exact(t), 1], dtype="<u4") for k, t in docs.items()}
    assert rows.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == np.cumsum([0, *seq.length.tolist()[:-1]]).tolist()
    edge = packing.pack(docs_of(spark, [None, ""]), queries.TOKENIZER).collect()
    assert [r["length"] for r in edge] == [1, 1] and packing.pack(docs_of(spark, []), queries.TOKENIZER).count() == 0


# ---------------------------------------------------------------- edits


@settings(max_examples=150, deadline=None)
@given(st.text("ab c\n'.1", max_size=80), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.text("xy z'\n2", max_size=12)), max_size=8), st.sampled_from([3, 8, 40]))
def test_edited_counts(text, edits, leaf):
    e = encoder(queries.TOKENIZER)
    tree = token_counts.PreTokenTree(text, e.count, leaf)
    for start, end, new in edits:
        tree.edit(start, end, new)
        a = min(start, len(text))
        b = min(max(end, a), len(text))
        text = text[:a] + new + text[b:]
        assert tree.text() == text and tree.chars[1] == len(text)
        assert tree.total() == len(e.exact(text))


def test_edits_touch_little(spark):
    text = prose(random.Random(5), 4000)
    tree = token_counts.PreTokenTree(text, encoder(queries.TOKENIZER).count)
    tree.encoded = 0
    tree.edit(9000, 9004, "word")
    assert tree.encoded < 2000 < len(text)
    docs = docs_of(spark, [text, None, ""])
    log = spark.createDataFrame([(0, 2, 0, 5, "b c"), (0, 1, 0, 0, "a "), (1, 1, 0, 0, "new words"), (2, 1, 3, 9, None)], "doc_id long, seq int, start long, end long, replacement string")
    rows = token_counts.counts_after_edits(token_counts.with_edits(docs, log), F.col("edits"), queries.TOKENIZER).orderBy("doc_id").collect()
    e = encoder(queries.TOKENIZER)
    want = "a " + text
    assert [r["n_tokens_edited"] for r in rows] == [e.count("b c" + want[5:]), e.count("new words"), 0]


def test_edited_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("edits", token_counts.trial_edits().cast(token_counts.EDITS)).collect()
    got = {r["doc_id"]: r for r in queries.queries()["op8_token_counts"](spark, sf_dir).collect()}
    e = encoder(queries.TOKENIZER)
    for r in docs[:80]:
        text = r["text"]
        for x in r["edits"]:
            a = min(x["start"], len(text))
            text = text[:a] + x["replacement"] + text[max(a, min(x["end"], len(text))) :]
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_tokens_edited"]) == (len(e.exact(r["text"])), len(e.exact(text)))


# ---------------------------------------------------------------- PII


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("ab.@-_%+ 0149()é\n", max_size=70))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (017) 555-5536 and +1-2", "256.1.1.1 001.2.3.4", "a@@b.c d@e.f.", "+" * 50 + "1" * 30, "1" * 3000])
def test_base_cases(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_contexts_discover(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{prose(rng, 20)} access key = "{key()}" {prose(rng, 5)}' for _ in range(12)]
    texts += [f'{prose(rng, 9)} access key = "ZZ-{k}-QQ77" end' for k in (1001, 1002)]
    texts += [f"{prose(rng, 9)} room 123{k}45 is free" for k in range(9)] + [None, "", "mail me at a.b@c.org"]
    rows = pii.extract(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
    start = texts[12].index("ZZ-")
    assert rows[12]["spans"] == f"secret:{start}:{start + 12}"
    assert all(r["n_discovered"] == 0 for r in rows[14:])
    assert pii.extract(docs_of(spark, [])).count() == 0


def test_discovery_recall(spark, monkeypatch):
    """Identifiers of unseen shape in contexts that seeds share: nine in ten are found, look-alikes elsewhere are not."""
    from tilegraph.functions import storage

    monkeypatch.setattr(storage, "HOT_ROWS", 5)
    rng = random.Random(16)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    cues = ['password: "{}"', "api token = {} ;", "write to {} today", "session <{}>", "secret key {}\n"]
    texts, planted = [], []
    for k in range(600):
        cue = cues[k % len(cues)]
        seed = f"{prose(rng, 1)}{k}@mail.example.org" if k % len(cues) == 2 else hexes(40) + "1a"
        secret = f"{prose(rng, 1, 'QRSTUV')}_{rng.randrange(10**6, 10**7)}-{prose(rng, 1, 'wxyz')}" if k % 12 == 0 else None
        head = prose(rng, rng.randint(3, 20)) + " "
        start = len(head) + cue.index("{}")
        texts.append(head + cue.format(secret or seed) + " " + prose(rng, 5))
        planted.append((start, start + len(secret)) if secret else None)
    plain = [f"{prose(rng, 8)} on page {rng.randrange(10**6, 10**7)} of volume_{rng.randrange(100, 999)} we read" for _ in range(200)]
    rows = pii.extract(docs_of(spark, texts + plain)).orderBy("doc_id").collect()
    spans = [{tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x} for r in rows]
    found = [p in s for p, s in zip(planted, spans, strict=False) if p]
    assert len(found) == 50 and sum(found) >= 0.9 * len(found)
    assert not any(spans[len(texts) :]) and all(r["n_spans"] == len(s) for r, s in zip(rows, spans, strict=True))


def test_discovered_spans_do_not_meet():
    rng = random.Random(17)
    for _ in range(300):
        base = [("card", a, a + rng.randint(1, 6)) for a in rng.sample(range(40), 4)]
        more = [{"kind": "secret", "start": a, "end": a + rng.randint(1, 6)} for a in rng.sample(range(40), 8)]
        want = []
        for s in sorted(more, key=lambda s: (s["start"], s["end"])):
            if all(s["end"] <= a or b <= s["start"] for _, a, b in base + want):
                want.append((s["kind"], s["start"], s["end"]))
        assert pii._apart(base, more) == want


def test_pii_rows(spark):
    docs = docs_of(spark, ["mail a.b@c.org", "mail a.b@c.org", None, "call +1 (017) 555-5536 " * 3000]).withColumn("doc_id", F.expr("nullif(doc_id, 1)"))
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "pattern", "more", "base", "kind", "start")})
    rows = {(r["doc_id"], r["n_email"], r["n_phone"], r["n_spans"]) for r in pii.extract(clash.union(clash)).collect()}
    assert rows == {(0, 1, 0, 1), (None, 1, 0, 1), (2, 0, 0, 0), (3, 0, 3000, 3000)}


# ---------------------------------------------------------------- licenses


def test_licenses(spark):
    texts = ["Copyright (c) 2020 Jane Doe\n\n" + licenses._MIT.upper().replace(",", " ;"), "words\nLicensed under the Apache Licence, version 2.0!\nmore", licenses._ISC, "nothing here", None, "", "Released under the MIT License.\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"]
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["whole_license"] for r in rows] == ["MIT", None, "ISC", None, None, None, None]
    assert [r["notices"] for r in rows] == ["", "Apache-2.0", "", "", "", "", "MIT"]
    assert [r["n_notices"] for r in rows] == [0, 1, 0, 0, 0, 0, 3]
    assert licenses.scan(docs_of(spark, [])).count() == 0
    own = spark.createDataFrame([("mine", hashlib.md5(b"nothing here").hexdigest())], "license string, digest string")
    assert licenses.scan(docs_of(spark, texts), own).where("whole_license = 'mine'").first()["doc_id"] == 3
    clash = docs_of(spark, texts).withColumns({c: F.lit("x") for c in ("digest", "license", "row", "lines", "notices")})
    assert rows == licenses.scan(clash.union(clash)).orderBy("doc_id").collect()  # repeated rows are reported once


def test_whole_license_texts(spark):
    """Each known text, in other letters, with a copyright line, as a comment, and spelt the British way."""
    rng = random.Random(12)
    names, texts = [], []
    for name, text in licenses.whole_texts():
        british = text.replace("license", "licence").replace("ization", "isation").replace("ize ", "ise ").replace("ized", "ised").replace("http:", "https:")
        shouted = "".join(c.upper() if rng.random() < 0.5 else c for c in text.replace(",", " , "))
        comment = "\n".join(" * " + line for line in text.split("\n"))
        for form in (text, "Copyright (c) 2021 Jane Doe. All rights reserved.\n\n" + text, british, shouted, comment):
            names.append(name)
            texts.append(form)
        names.append(None)
        texts.append(text.replace("software", "hardware").replace("the", "thee") + " save on Sundays")
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["whole_license"] for r in rows] == names
    assert [r["digest"] for r in rows] == [hashlib.md5(licenses.canonical_text(t).encode()).hexdigest() for t in texts]
    assert {n for n in names if n} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"}
    import duckdb

    got = duckdb.connect().execute(f"SELECT md5({licenses._sql('t')}) FROM (SELECT unnest(?::VARCHAR[]) AS t)", [texts]).fetchall()
    assert [r["digest"] for r in rows] == [r[0] for r in got]


# ---------------------------------------------------------------- decontamination


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_lcs(a, b):
    assert decontam.lcs(a, b) == lcs_by_table(a, b)


def leaks(spark):
    rng = random.Random(9)
    words = [prose(rng, 1) for _ in range(1500)]
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [say(rng.randint(14, 55)) for _ in range(30)]
    texts, truth = [" ".join(say(rng.randint(30, 300))) for _ in range(150)], set()
    for k, item in enumerate(items):
        for _ in range(3):
            at = say(rng.randint(0, 120))
            body = list(item)
            if rng.random() < 0.5:  # reworded: a few words changed, a few put in
                for _ in range(len(body) // 8):
                    body[rng.randrange(len(body))] = rng.choice(words)
            truth.add((len(texts), k))
            texts.append(" ".join(at + body + say(rng.randint(0, 120))))
    return texts, [" ".join(i) for i in items], truth


def test_leaks_are_found(spark):
    texts, items, truth = leaks(spark)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()}
    # retrieval against its exhaustive counterpart: every window and item whose answer words suffice is verified
    every = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, cosine=-1.0).collect()}
    assert got == every == truth
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, most_words=300).collect()}
    assert parts == truth
    staged = decontam.stage(docs, bench)
    assert staged.columns == docs.columns and {r["doc_id"] for r in staged.collect()} == set(range(len(texts))) - {d for d, _ in got}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.lists(st.lists(st.integers(-1, 3), max_size=40), min_size=1, max_size=4))
def test_verbatim_copies(items, texts):
    numbers = np.asarray([w for t in texts for w in t], dtype=np.int64)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    at, found = decontam.Verbatim([np.asarray(i, dtype=np.int64) for i in items]).find(numbers, ends)
    want, base = set(), 0
    for t in texts:
        want |= {(base + p, k) for k, i in enumerate(items) for p in range(len(t) - len(i) + 1) if i and t[p : p + len(i)] == i}
        base += len(t)
    assert sorted(zip(at.tolist(), found.tolist(), strict=True)) == sorted(want)


def test_copies_of_any_item_are_found(spark):
    """Short items, items of common words only and long ones, each verbatim among many other words."""
    rng = random.Random(13)
    common = [prose(rng, 1) for _ in range(12)]
    say = lambda n: [rng.choice(common) for _ in range(n)]
    items = [["zzone"], ["two", "wordsx"], ["a", "b", "cc"], say(9), say(20), say(400), [f"u{k}" for k in range(30)]]
    texts, truth = [], set()
    for i in range(140):
        k = i % len(items)
        texts.append(" ".join(["filler", *say(rng.randint(0, 50)), "stop", *items[k], "stop", *say(rng.randint(0, 50))]))
        truth.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = decontam.matches(docs_of(spark, texts), bench).collect()
    assert truth <= {(r["doc_id"], r["item_id"]) for r in found}
    assert {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] in (0, 1, 2, 6)} == {t for t in truth if t[1] in (0, 1, 2, 6)}
    assert all((r["lcs"], r["answer"]) == (1.0, 1.0) for r in found if (r["doc_id"], r["item_id"]) in truth)


def test_a_passage_that_leaks_often_is_found(spark):
    rng = random.Random(10)
    words = [prose(rng, 1, "klmnopqrst") for _ in range(1500)]
    item = [prose(rng, 1) for _ in range(20)]
    texts, truth = [], set()
    for i in range(240):
        body = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            copy = list(item)
            if i % 2:  # reworded
                copy[rng.randrange(10)] = rng.choice(words)
                copy.insert(rng.randrange(10, 20), rng.choice(words))
            at = rng.randrange(61)
            body[at:at] = copy
            truth.add(i)
        texts.append(" ".join(body))
    docs, bench = docs_of(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.matches(docs, bench).collect()} == truth
    assert {r["doc_id"] for r in decontam.stage(docs, bench).collect()} == set(range(240)) - truth


def test_rarer_words_beside_a_copy_do_not_hide_it(spark):
    rng = random.Random(11)
    words = [prose(rng, 1, "klmnopqrst") for _ in range(1500)]
    often = [prose(rng, 1) for _ in range(20)]
    seldom = [[f"w{k}x{j}" for j in range(20)] for k in range(30)]
    some = [f"s{j}" for j in range(20)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts, truth = [], set()
    for i in range(240):
        body = say(60)
        for k, item, step in ((0, often, 3), (1, some, 20)):
            if i % step == 0:
                # words of many other items stand around the copy, too few of each to hold one
                around = [w for q in rng.sample(range(30), 20) for w in [rng.choice(seldom[q])]]
                body += around + item + around[::-1]
                truth.add((i, k))
        texts.append(" ".join(body))
    items = [often, some, *seldom]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs_of(spark, texts), bench).collect()}
    assert got == truth


def test_leak_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [None, "", "one two three"])
    assert decontam.matches(docs, empty).count() == 0
    none = spark.createDataFrame([(2, None), (3, ""), (4, " . ")], "item_id long, text string")
    assert decontam.matches(docs, none).count() == 0
    short = none.union(spark.createDataFrame([(1, "Two, three!"), (5, "four"), (1, "two three")], "item_id long, text string"))
    assert [tuple(r)[:2] for r in decontam.matches(docs, short).collect()] == [(2, 1)]
    assert decontam.matches(docs.limit(0), short).count() == 0
    assert decontam.stage(docs, short).count() == 2
    clash = docs.withColumns({c: F.lit("x") for c in ("item_id", "term", "n", "__held", "cosine")}).withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    assert [tuple(r)[:2] for r in decontam.matches(clash.union(clash), short).collect()] == [(None, 1)]
    kept = decontam.stage(clash, short)
    assert kept.columns == clash.columns and kept.count() == 3  # a row without an id can't be named, and stays


def test_benchmark_passages_of_the_tables(spark, sf_dir):
    squeeze = lambda t: " ".join(t.split())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r["item_id"], squeeze(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    truth = {(d["doc_id"], k) for d in docs for k, t in items if t in squeeze(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op10_benchmark_decontamination"](spark, sf_dir).collect()}
    assert truth <= got


# ---------------------------------------------------------------- odd rows


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names, in every operator on documents."""
    rng = random.Random(15)
    long = prose(rng, 150_000)
    texts = [None, "", "a", long, "x" * 1_000_000, "repeated row", "repeated row", "1" * 300_000, "\u0000 \ud7ff é\r\n" * 50]
    docs = docs_of(spark, texts, lambda i: None if i == 2 else "a").withColumn("doc_id", F.expr("case when doc_id = 5 then 6 when doc_id = 2 then null else doc_id end"))
    names = "row key mark uid h n start end band first size kept site host keys line digest license term item_id score predicted edits wanted spans tokens length offset ids pages found".split()
    docs = docs.withColumns({c: F.lit("x") for c in names})
    labels = spark.createDataFrame([(3, 1, None), (None, None, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no such words here at all in any of these texts"), (None, "a"), (2, None)], "item_id long, text string")
    count = {
        "lines": lambda d: queries.line_dedup.query(d).count(),
        "repeats": lambda d: queries.rindex.remove_repeats(d).count(),
        "toxicity": lambda d: toxicity.score(d, labels).where("score between 0 and 1").count(),
        "pii": lambda d: pii.extract(d).where("n_spans >= 0").count(),
        "near": lambda d: queries.bagminhash.near_duplicates(d).where("kept is not null").count(),
        "tokens": lambda d: token_counts.counts_after_edits(d, token_counts.trial_edits(), queries.TOKENIZER).where("n_tokens_edited >= 0").count(),
        "packing": lambda d: packing.pack(d, queries.TOKENIZER).where("start = 0").count(),
    }
    for name, rows in count.items():
        assert rows(docs) == len(texts), name
        assert rows(docs.limit(0)) == 0, name
    assert licenses.scan(docs).count() == len(texts) - 1  # repeated rows are one
    assert decontam.matches(docs, bench).count() == 0
    whole = packing.pack(docs, queries.TOKENIZER).where("doc_id = 3").selectExpr("sum(length)", "max(doc_tokens)").first()
    assert whole[0] == whole[1] == len(encoder(queries.TOKENIZER).exact(long)) + 1
