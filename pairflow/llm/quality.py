"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps what was measured and one bit per failed
rule; which failures matter is decided afterwards by a policy, a named and versioned mask over
those bits, so that policies can be changed and compared without reading the texts again.
Built-in functions only: a text's words, lines and windows stay arrays inside its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import SPACES, columns, let, quoted, spare, table, words

WINDOW = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts"]


@dataclass(frozen=True)
class Rule:
    """Fails where ``test`` of the measures is true. ``bit`` is its place in the ledger and never reused."""

    bit: int
    name: str
    test: Callable[[Column], Column]


RULES = [
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule(3, "repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule(4, "long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule(5, "shouting", lambda m: 100 * m["n_shouts"] > 30 * m["n_words"]),
]

BASE = ["few_words", "repeated_windows"]
"""Rules that no policy can waive."""

POLICIES = {
    "base-1": BASE,
    "web-1": [*BASE, "symbols", "repeated_lines"],
    "web-2": [*BASE, "symbols", "repeated_lines", "long_words", "shouting"],
}
POLICY = "web-2"


def mask(names: list[str], rules: list[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def _repeated_positions(w: Column, n: int) -> Column:
    """Starts of the n-word windows that another place in the same text repeats, in no order."""
    windows = F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - n),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]),
        )
    )

    def pick(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )
        # Most texts repeat nothing, which a hash set tells without a sort.
        none = F.array().cast("array<int>")
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(twice)

    return let(windows, pick)


def _covered(starts: Column, n: int) -> Column:
    """How many places the windows of length ``n`` at ``starts`` cover."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-n).alias("last"))
    return F.aggregate(
        F.sort_array(starts),
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.least(F.lit(n), x - a["last"]).cast("bigint")).alias("n"), x.alias("last")
        ),
        lambda a: a["n"],
    )


def measures(text: Column) -> Column:
    """All measurements of one text as a struct of longs, named as in ``MEASURES``."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

        def of_words(w: Column) -> Column:
            return let(
                lines,
                lambda ls: F.struct(
                    *[
                        value.cast("bigint").alias(name)
                        for name, value in {
                            "n_words": F.size(w),
                            "word_chars": F.length(F.array_join(w, "")),
                            "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
                            "n_lines": F.size(ls),
                            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
                            "n_repeat_words": _covered(_repeated_positions(w, WINDOW), WINDOW),
                            "n_shouts": F.regexp_count(t, F.lit("!!")),
                        }.items()
                    ]
                ),
            )

        return let(words(t), of_words)

    return let(F.coalesce(text, F.lit("")), of_text)


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, bits: str = "failure_bits") -> DataFrame:
    """Each row of ``docs`` with its measurements and failure bits (bigint).

    A null or empty text has no words: every count is 0 and ``few_words`` fails. Repeated rows
    are judged each for itself; an empty table gives an empty ledger. Columns of ``docs`` named
    like a measurement or like ``bits`` are replaced; all others stay as they are.
    """
    (m,) = spare(docs, "measured")
    failed = [F.when(r.test(F.col(m)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules]
    every = failed[0]
    for f in failed[1:]:
        every = every.bitwiseOR(f)
    out = docs.withColumn(m, measures(F.col(quoted(text))))
    return out.withColumns({name: F.col(m)[name] for name in MEASURES} | {bits: every}).drop(m)


def apply_policy(
    ledger_: DataFrame, policy: str = POLICY, policies: dict[str, list[str]] = POLICIES, bits: str = "failure_bits"
) -> DataFrame:
    """Add ``policy``, ``base_failed`` and ``kept``: a row stays if the policy's mask meets none of its bits."""
    base, own = mask(BASE), mask(policies[policy]) | mask(BASE)
    return ledger_.withColumns(
        {
            "policy": F.lit(policy),
            "base_failed": F.col(bits).bitwiseAND(F.lit(base)) != 0,
            "kept": F.col(bits).bitwiseAND(F.lit(own)) == 0,
        }
    )


def ablations(
    ledger_: DataFrame,
    policies: dict[str, list[str]] = POLICIES,
    rules: list[Rule] = RULES,
    bits: str = "failure_bits",
) -> DataFrame:
    """What each rule does under each policy, from the bits alone.

    Rows (policy, rule, n_rows, rejected, by_rule, by_rule_alone, with_rule): how many rows the
    policy rejects, how many of them fail this rule, how many are rejected by nothing else (they
    come back when the rule is dropped), and the union of the bits that fail together with it.
    The texts are aggregated to at most 2 to the number of rules rows before anything else.
    """
    counts = ledger_.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(
        *[
            F.struct(
                F.lit(name).alias("policy"),
                F.lit(r.name).alias("rule"),
                F.lit(mask(names)).cast("bigint").alias("mask"),
                F.lit(1 << r.bit).cast("bigint").alias("bit"),
            )
            for name, names in policies.items()
            for r in rules
            if r.name in names
        ]
    )
    each = counts.select("bits", "n", F.explode(cases).alias("c")).select("bits", "n", "c.*")
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    own = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_rows"),
        total(hit != 0).alias("rejected"),
        total(own).alias("by_rule"),
        total(hit == F.col("bit")).alias("by_rule_alone"),
        F.coalesce(F.bit_or(F.when(own, F.col("bits"))), F.lit(0).cast("bigint")).alias("with_rule"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements and the verdict of the current policy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_policy(ledger(docs).drop("text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failure_bits", "policy",
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the current policy keeps, columns unchanged."""
    bits, verdict = spare(docs, "bits", "rejected")
    own = mask(POLICIES[POLICY]) | mask(BASE)
    (m,) = spare(docs, "measured")
    failed = F.lit(False)
    for r in RULES:
        if own >> r.bit & 1:
            failed = failed | r.test(F.col(m))
    judged = docs.withColumn(m, measures(F.col("text"))).withColumn(verdict, failed)
    return judged.where(~F.col(verdict)).select(*columns(docs))


OP7_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), win AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM cut WHERE len(w) >= 3
), named AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM named) WHERE c > 1
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts
  FROM cut LEFT JOIN cover USING (r)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2
    + (100 * n_symbols > 30 * n_words)::BIGINT * 4 + (100 * n_dup_lines > 50 * n_lines)::BIGINT * 8
    + (word_chars > 15 * n_words)::BIGINT * 16 + (100 * n_shouts > 30 * n_words)::BIGINT * 32)::BIGINT AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits, 'web-2' AS policy
FROM b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does to all documents under each policy, from the ledger's bits."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("text")))


_CASES = ", ".join(
    f"('{policy}', '{r.name}', {mask(names)}, {1 << r.bit})" for policy, names in POLICIES.items() for r in RULES if r.name in names
)

ABLATIONS_SQL = (
    OP7_SQL.rpartition("SELECT doc_id")[0]
    + f"""
SELECT policy, rule, count(*)::BIGINT AS n_rows,
  count(*) FILTER (failure_bits & mask <> 0)::BIGINT AS rejected,
  count(*) FILTER (failure_bits & bit <> 0)::BIGINT AS by_rule,
  count(*) FILTER (failure_bits & mask = bit)::BIGINT AS by_rule_alone,
  coalesce(bit_or(failure_bits) FILTER (failure_bits & bit <> 0), 0)::BIGINT AS with_rule
FROM b, (VALUES {_CASES}) AS cases(policy, rule, mask, bit)
GROUP BY policy, rule
"""
)
