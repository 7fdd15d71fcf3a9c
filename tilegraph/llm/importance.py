"""Importance resampling towards a target distribution by hashed n-grams.

The position table has a row a word: posexplode() of a document's words, and lead() in a window over the document
brings the following words beside it, so that each order of n-grams is one column. Their hashes fall into buckets; the
buckets are counted over the whole corpus and over the whole target, each bucket has a gain (the logarithm of
the ratio of its two smoothed shares, in thousandths), and a document's weight is the mean gain of its n-grams. A
draw without replacement adds a Gumbel term, derived from the doc_id, to each weight and takes the highest scores.

Defined cases: a null or wordless text has no features, weight 0 and no rank; a row without a doc_id is scored with
an empty id; repeated rows are rows of their own (ties end with the row's place); an empty target gives each bucket
the gain of its smoothed share; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .common import discard, materialise
from .sql import CRC_TABLE, crc32

BUCKETS = 10_000
ORDERS = 2
#: Documents of fewer words are never drawn; the draw takes this many hundredths of the others.
LEAST_WORDS, PER_CENT = 20, 25
SEED = 7
#: What stands between words: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order, A to Z in lower case; none of a null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def _buckets(orders: int) -> list[str]:
    return [f"b{k}" for k in range(1, orders + 1)]


def position_table(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """(row, doc_id, pos, b1 ... bk): for each word the buckets of the runs of 1 to k words that begin with it.

    bk is null where the document ends before; a document without words has one row without a pos. Whole texts
    are dealt out once, by row; the window over a document finds them there and streams, however long one is.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col("text"))
    told = rows.repartition("row").select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "w"))
    document = W.partitionBy("row").orderBy("pos")
    ahead = told.withColumns({f"w{k}": F.lead("w", k).over(document) for k in range(1, orders)})
    gram, out = F.col("w"), []
    for k in range(1, orders + 1):
        gram = gram if k == 1 else F.concat(gram, F.lit(" "), F.col(f"w{k - 1}"))  # null beyond the end
        out.append((F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"b{k}"))
    return ahead.select("row", "doc_id", "pos", *out)


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) over a whole position table; counts are added up before the shuffle."""
    each = table.select(F.explode(F.array(*_buckets(orders))).alias("bucket"))
    return each.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the bucket_counts() of the corpus and of the target; a row a bucket."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    real = lambda c: F.col(c).cast("double")
    ratio = ((real("t") + 1) * (real("all_s") + buckets)) / ((real("s") + 1) * (real("all_t") + buckets))
    return each.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def _gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-F.log(-F.log((h + 0.5) / 4294967296.0)) * 1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED, target_key: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... of those drawn, by score; else null), n_words.

    The table of gains has one row a bucket, so it is broadcast; a document's gains are summed before any shuffle.
    """
    table = materialise(position_table(docs, orders, buckets))
    wanted = bucket_counts(position_table(target, orders, buckets, target_key), orders)
    gain = materialise(gains(bucket_counts(table, orders), wanted, buckets))
    each = table.select("row", "doc_id", F.posexplode(F.array(*_buckets(orders))).alias("k", "bucket"))  # without words: nulls
    told = each.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id")
    n_words = F.count(F.when(F.col("k") == 0, F.col("bucket")))
    told = told.agg(F.count("bucket").alias("n_features"), n_words.alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    scored = told.withColumn("weight", weight).withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    placed = numbered(scored.drop("total"), enough.desc(), F.desc("score"), F.asc("doc_id"), F.asc("row"), name="place")
    drawn = (placed.agg(F.count_if(enough)).first()[0] or 0) * per_cent // 100
    discard(table)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"), "n_words")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target)


def _features_sql(table: str) -> str:
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{BETWEEN[1:-2]}]+')"
    return f"SELECT row, doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM (SELECT row_number() OVER () AS row, doc_id, {found} AS w FROM {table})"


ORACLE_SQL = f"""WITH {CRC_TABLE}, docs AS ({_features_sql("documents")}), target AS ({_features_sql("(SELECT item_id AS doc_id, text FROM benchmark)")}
), told AS (SELECT row, unnest(f) AS f FROM docs), wanted AS (SELECT unnest(f) AS f FROM target
), hashed AS (SELECT f, {crc32("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM told UNION SELECT f FROM wanted), crc_table
), s AS (SELECT bucket, count(*) AS s FROM told JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket
), totals AS (SELECT (SELECT count(*) FROM told)::DOUBLE AS all_s, (SELECT count(*) FROM wanted)::DOUBLE AS all_t
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), totals
), weights AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM told JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, len(w) AS n_words, len(f) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row)
), placed AS (SELECT *, row_number() OVER (ORDER BY n_words >= {LEAST_WORDS} DESC, score DESC, doc_id, row) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS}) * {PER_CENT} // 100 THEN place END AS rank, n_words FROM placed"""
