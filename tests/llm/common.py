"""What the corpus tests share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=lambda i: "a"):
    """A documents table of the given texts, null ones too."""
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
