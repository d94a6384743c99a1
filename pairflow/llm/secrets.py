"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived:
what a text must hold for the expression to match at all. The postings of those trigrams, one row
per (trigram, text), are intersected clause by clause; only texts that remain are matched against
the expression. A rule that no trigram is mandatory for scans every text. Built-in functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _parser as syntax  # the standard library's own reader of expressions

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import columns, let, quoted, row_key, spare, stored, table

OPEN, CLOSE, STAND_IN = "\x01", "\x02", "\x03"
"""Marks set around matches. Texts that hold them have them exchanged for the stand-in first, which
keeps every position; rules must not match these three characters."""


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, of which ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False


RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    # Beyond the base: other public credential forms.
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    # From the start of a run of its characters, each run read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 30),
    Rule("pem", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", 20),
]
BASE = 3

MOST_STRINGS = 32
"""Alternatives that the derivation keeps apart; beyond it only the mandatory trigrams are kept."""


# --- trigram queries -------------------------------------------------------------------------
# A query is a set of clauses, a clause a set of trigrams: a text may match if it holds all
# trigrams of some clause. {frozenset()} is the query that every text satisfies.

ANY = frozenset([frozenset()])


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST_STRINGS:
        return a if b == ANY else b
    return frozenset(x | y for x, y in product(a, b))


def _either(queries: list[frozenset]) -> frozenset:
    out = frozenset().union(*queries)
    return ANY if frozenset() in out else out


def _sequence(items: list) -> tuple[set[str] | None, frozenset]:
    """(all strings that the items match, or None if too many; what they need besides)."""
    need, run = ANY, {""}
    whole = True

    def close(run: set[str]) -> frozenset:
        return _either([frozenset([_grams(s)]) for s in run])

    for item in items:
        strings, own = _item(item)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        need = _both(need, close(run))
        if strings is None:
            need, run = _both(need, own), {""}
        else:
            run = strings
    return (run, ANY) if whole else (None, _both(need, close(run)))


def _item(item: tuple) -> tuple[set[str] | None, frozenset]:
    op, arg = item
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, ANY
    if name == "SUBPATTERN":
        return _sequence(list(arg[3]))
    if name == "BRANCH":
        parts = [_sequence(list(b)) for b in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*[s for s, _ in parts]), ANY
        needs = [q if s is None else _either([frozenset([_grams(x)]) for x in s]) for s, q in parts]
        return None, _either(needs)
    if name == "IN":
        found = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (found, ANY) if len(found) <= 8 else (None, ANY)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, need = _sequence(list(inner))
        if strings is not None and high == 1 and low <= 1:
            return (strings | {""} if low == 0 else strings), ANY
        if low == 0:
            return None, ANY
        if strings is not None:
            need = _either([frozenset([_grams(s * low if len(strings) == 1 else s)]) for s in strings])
        return None, need
    if name == "AT":
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of lower-case trigrams, of which a matching text holds one whole clause.

    Empty where nothing is mandatory: such a rule scans fully. The index is over lower-cased texts,
    so letters of either case meet the same trigrams; that only adds candidates.
    """
    strings, need = _sequence(list(syntax.parse(pattern)))
    query = need if strings is None else _either([frozenset([_grams(s)]) for s in strings])
    smallest = [c for c in query if not any(o < c for o in query)]
    return [] if frozenset() in query else sorted(sorted(c) for c in smallest)


# --- index -----------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index of ``trigrams``: one row (trigram, ``key``) for each text that holds it."""
    lower = F.lower(F.coalesce(F.col(quoted(text)), F.lit("")))
    held = let(
        lower,
        lambda t: F.filter(
            F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull()
        ),
    )
    return docs.select(F.col(key), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row (``key``, kinds) per text that satisfies the query of at least one rule.

    The queries are a fixed table of the rules' trigrams, a few rows, and so may be broadcast.
    """
    terms = [
        (rule.kind, c, len(clause), g)
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for g in clause
    ]
    query = index.sparkSession.createDataFrame(terms, "kind string, clause int, needs int, trigram string")
    whole = (
        index.join(F.broadcast(query), "trigram")
        .groupBy(key, "kind", "clause", "needs")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") >= F.col("needs"))
    )
    return whole.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


# --- spans -----------------------------------------------------------------------------------

BLOCK = 128


def _starts(lengths: Column) -> Column:
    """Sums of all earlier lengths: within blocks, then over blocks, so that long arrays stay cheap."""

    def sums(xs: Column) -> Column:
        zero = F.struct(F.array().cast("array<bigint>").alias("s"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            xs,
            zero,
            lambda a, x: F.struct(F.concat(a["s"], F.array(a["n"])).alias("s"), (a["n"] + x).alias("n")),
            lambda a: a["s"],
        )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def by_block(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        return let(
            blocks,
            lambda bs: let(
                sums(F.transform(bs, total)),
                lambda ahead: F.flatten(
                    F.transform(bs, lambda b, i: F.transform(sums(b), lambda v: v + F.get(ahead, i)))
                ),
            ),
        )

    return let(lengths, by_block)


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def pieces(text: Column, rule: Rule) -> Column:
    """The text cut at the rule's matches: other text at even places, matches at odd ones."""
    clean = F.translate(text, OPEN + CLOSE, STAND_IN * 2)
    # The shortest match that can count, as a cheap look ahead of the cut: most texts have none.
    marked = F.regexp_replace(clean, F.lit(_java(rule)), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.split(marked, f"[{OPEN}{CLOSE}]")


def counts(piece: Column, rule: Rule) -> Column:
    """Whether a match is long enough to stand."""
    part = piece if rule.group == 0 else F.regexp_extract(piece, _java(rule), rule.group)
    return F.length(part) >= rule.least


def _quick(text: Column, rule: Rule) -> Column:
    """False for texts that cannot hold a standing match; exact for one repeated class, else a plain match."""
    simple = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    pattern = f"{simple[1]}{{{rule.least}}}" if simple else _java(rule)
    return text.rlike(pattern)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the standing matches; code points, end exclusive."""
    kind = "array<struct<start:bigint,number:int,end:bigint>>"

    def of(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x).cast("bigint"))
        return let(
            _starts(lengths),
            lambda at: F.filter(
                F.transform(
                    p,
                    lambda x, i: F.when(
                        (i % 2 == 1) & counts(x, rule),
                        F.struct(
                            F.get(at, i).alias("start"),
                            F.lit(number).alias("number"),
                            (F.get(at, i) + F.length(x)).alias("end"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    return F.when(_quick(text, rule), let(pieces(text, rule), of)).otherwise(F.array()).cast(kind)


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, into: str = "secrets") -> DataFrame:
    """Each row of ``docs`` with ``into``: its standing matches as (start, number, end), by start, then rule number.

    The row's content is its key in the index, so null and repeated ids do no harm: equal rows
    have equal results, and are joined to one candidate row. A null text is empty and has no
    match. A column of ``docs`` named like ``into`` is replaced. The index is read once to find
    candidates; the texts then stream past the (narrow) candidate rows of the same key.
    """
    key, kinds = spare(docs, "key", "kinds")
    keyed = docs.withColumn(key, row_key(docs))
    indexed = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({g for q in indexed.values() for c in q for g in c})
    met = keyed.withColumn(kinds, F.array().cast("array<string>"))
    if trigrams:
        index = postings(keyed, key, text, trigrams)
        found = candidates(index, key, rules).withColumnRenamed("kinds", kinds)
        met = keyed.join(found.hint("shuffle_hash"), key, "left")
    value = F.coalesce(F.col(quoted(text)), F.lit(""))
    each = []
    for number, rule in enumerate(rules):
        hits = spans(value, rule, number)
        if indexed[rule.kind]:
            asked = F.coalesce(F.array_contains(F.col(kinds), rule.kind), F.lit(False))
            hits = F.when(asked, hits).otherwise(F.array().cast("array<struct<start:bigint,number:int,end:bigint>>"))
        each.append(hits)
    return met.withColumn(into, F.array_sort(F.concat(*each))).drop(key, kinds)


def listed(spans_: Column, rules: list[Rule] = RULES) -> Column:
    """Spans as text, kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"], s["end"])), ","
    )


PIECE = 4096
"""Characters of the pieces that a text is cut into before parts of it are taken."""
def _running_max(values: Column) -> Column:
    """The greatest of each value and all before it (values are not negative): within blocks, then over blocks."""

    def within(xs: Column) -> Column:
        zero = F.struct(F.array().cast("array<bigint>").alias("s"), F.lit(0).cast("bigint").alias("m"))

        def add(a: Column, x: Column) -> Column:
            most = F.greatest(a["m"], x)
            return F.struct(F.concat(a["s"], F.array(most)).alias("s"), most.alias("m"))

        return F.aggregate(xs, zero, add, lambda a: a["s"])

    def by_block(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        return let(
            blocks,
            lambda bs: let(
                within(F.transform(bs, F.array_max)),
                lambda most: F.flatten(
                    F.transform(bs, lambda b, i: F.transform(within(b), lambda v: F.when(i > 0, F.greatest(v, F.get(most, i - 1))).otherwise(v)))
                ),
            ),
        )

    return let(values, by_block)


def redact(text: Column, spans_: Column, filler: str = "[REDACTED]") -> Column:
    """The text with each maximal run of overlapping or touching spans exchanged for ``filler``.

    ``spans_`` are sorted by start. A gap lies between the greatest end so far and the next start; it is taken from the
    pieces of the text that it lies in, so the work grows with the text and the spans, not with their product.
    """

    def rebuild(pieces_: Column, ends: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            some = F.array_join(F.slice(pieces_, first + 1, F.floor(F.greatest(b - 1, a) / PIECE).cast("int") - first + 1), "")
            return F.substring(some, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

        def gap(i: Column) -> Column:
            a = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))
            b = F.coalesce(F.get(spans_, i)["start"], F.length(text).cast("bigint"))
            # Spans that touch leave no gap, unless it is the one ahead of the first or behind the last.
            return F.when((i == 0) | (i == F.size(ends)) | (b > a), F.when(b > a, cut(a, b)).otherwise(F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ends)), gap), filler)

    pieces_ = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = _running_max(F.transform(spans_, lambda s: s["end"]))
    return F.when(F.size(spans_) == 0, text).otherwise(let(pieces_, lambda p: let(ends, lambda e: rebuild(p, e))))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets counted, listed and digested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secrets")

    def count(number: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["number"] == number)).cast("bigint")

    base = F.filter("secrets", lambda s: s["number"] < BASE)
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(RULES[:BASE])],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, its secrets hidden; ``n_chars`` is counted anew where that changes a text."""
    (found,) = spare(docs, "found")
    hidden = scan(docs, into=found)
    text = F.col("text")
    cleaned = {"text": F.when(F.size(found) > 0, redact(text, F.col(found))).otherwise(text)}
    out = hidden.select(*[cleaned["text"].alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns], found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*columns(docs))
