"""Mixing sources to target weights by systematic sampling.

Within a source the rows stand on a line, each as long as its expected number of copies. One
offset, the same for the whole source, lays marks at every whole number; a row is taken once for
every mark on its stretch. So a source gets its share to within one row, and no row more copies
than its expectation rounded up. Stretches are found without putting a source into one task: the
line is cut into buckets along its order, and only one row per bucket is summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import columns, n_words, quoted, row_digest, spare, stored, table
from pairflow.operators.ordering import row_index

WEIGHTS = [5, 2, 1]
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def targets(
    sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """The words each source is to give: (source, source_size, target).

    ``sizes`` has one row per source (source, source_size). Sources in code point order, null last,
    take the weights in turn and split ``share`` of all words by them; none gets more than ``most``
    times its own size, what it leaves goes to the others by weight, until none is above. Each
    round is one sum over the sources that are left; there are as many rounds as it takes.
    """
    isnull, prefix = F.col("source").isNull(), F.coalesce(F.substring("source", 1, 3), F.lit(""))
    placed = row_index(
        sizes,
        [],
        [F.col("source").asc_nulls_last()],
        F.struct(isnull.alias("a"), prefix.alias("b")),
        name="place",
    )
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    open_ = stored(placed.select("source", "source_size", turn.alias("weight")))
    total = open_.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(most) * F.col("source_size")
    level = 0.0
    while True:
        # A source is full at this level or it is not; fullness never ends as the level only rises.
        full = cap <= F.lit(level) * F.col("weight")
        left, weight = open_.agg(
            F.lit(share * total) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not weight or left / weight <= level:
            break
        level = left / weight
    return open_.select(
        "source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target")
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's offset in [0, 1): 32 bits of a digest of the seed and its name, equal in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(source, F.lit("null")).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def copies(docs: DataFrame, key: str, size: str, source: str, seed: str = SEED, ties: tuple[str, ...] = (), **aims: object) -> DataFrame:
    """``docs`` with source_size, target, and how many copies of each row the mix takes (``n_copies``).

    Rows stand by the leading bits of their size, then by a digest of ``key``: neighbours are of
    like size, so the words taken come near the target too. All rows of a source have the same
    expectation, target / source_size; a source without words gives no copies. Null sources are
    one source; null and repeated keys each keep a row's place of their own. Rows of equal key and size stand
    by the columns ``ties``; what these leave equal is told apart by nothing here, so that only rows equal in
    all of these columns can change places between runs. An empty table gives an empty one.
    """
    own, at, none = spare(docs, "source", "place", "isnull")
    s = F.col(quoted(source))
    sizes = docs.groupBy(s.alias("source")).agg(F.coalesce(F.sum(quoted(size)), F.lit(0)).cast("bigint").alias("source_size"))
    goal = targets(sizes, **aims).select(
        F.coalesce("source", F.lit("")).alias(own), F.col("source").isNull().alias(none), "source_size", "target"
    )
    bits = F.bin(F.col(quoted(size)))
    digest = F.md5(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("null")).cast("binary"))
    place = F.struct(F.length(bits).alias("a"), F.substring(bits, 1, 4).alias("b"), F.substring(digest, 1, 2).alias("c"))
    keyed = docs.withColumns({own: F.coalesce(s, F.lit("")), none: s.isNull()})
    placed = row_index(keyed, [own, none], [digest.asc(), F.col(quoted(size)).asc(), *[F.col(quoted(t)) for t in ties]], place, name=at)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(s, seed)
    crossed = F.floor((F.col(at) + 1) * rate + start) - F.floor(F.col(at) * rate + start)
    return (
        placed.join(goal, [own, none])
        .withColumn("n_copies", crossed.cast("bigint"))
        .drop(own, none, at)
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = copies(stored(docs), "doc_id", "size", "source")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies"
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, columns unchanged.

    Copies are found on (key, size, source) alone and then joined to the texts by the row's content,
    of which the larger side is only streamed past. Rows equal in every column share one key and
    so the sum of their copies. Rows of one id stand by their content, so reruns take the same texts.
    """
    key, size, of, n, number = spare(docs, "key", "size", "same", "n", "number")
    thin = stored(
        docs.select("doc_id", "source", row_digest(docs).alias(key), n_words(F.col("text")).alias(size))
    )
    taken = (
        copies(thin, "doc_id", size, "source", ties=(key,))
        .groupBy(F.col(key))
        .agg(F.sum("n_copies").alias(n), F.count(F.lit(1)).alias(of))
        .where(F.col(n) > 0)
    )
    met = docs.withColumn(key, row_digest(docs)).join(taken.hint("shuffle_hash"), key)
    # Equal rows cannot be told apart: one of them stands for all and carries their copies.
    once = met.where(F.col(of) == 1)
    many = met.where(F.col(of) > 1).dropDuplicates([key])
    return (
        once.unionByName(many)
        .withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
        .select(*columns(docs))
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM o
), lv AS (
  SELECT max(level) AS level FROM (
    SELECT (total - capped) / rest AS level, cap / weight AS edge FROM f
  ) WHERE level <= edge
), goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM lv), 1e300) * weight) AS target FROM o
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1-' || coalesce(d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), substr(bin(d.size), 1, 4),
      md5(coalesce(d.doc_id::VARCHAR, 'null')), d.size) - 1 AS i
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  ((floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT * size)::BIGINT AS taken,
  (floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT AS n_copies
FROM p
"""
