"""Phrases whose words stand together more often than their parts would.

Two passes over the words. The first cuts the texts into blocks, and each block sends a summary (hashes and
counts of its n-grams) to every hash partition. A partition merges them as Misra-Gries summaries of more
counters than its mass divided by the threshold, so that no n-gram that reaches the threshold is lost, and
tells each block which of its own hashes remain. The second pass counts those n-grams by their words, exactly.

Blocks and hash partitions are of bounded size whatever the input: partitions grow in number with the bytes of text.
An n-gram stands once in a block's summary, so a very frequent one is a row per block at most.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, stored, table

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
"""Words of a phrase; occurrences of a phrase; percent of them in a longer one that make it a part; phrases of a language."""
FACTOR = 2_000_000
"""What a score of 1 is multiplied by before the fraction is cut."""
BLOCK = 6_000_000
"""Bytes of text from which a block is full."""
PARTITION_BYTES = 64_000_000
"""Bytes of text for each hash partition; there are ``LEAST_PARTITIONS`` or more, a power of two."""
LEAST_PARTITIONS = 64
BUFFER = 2_000_000
"""Entries that a partition gathers before it merges them, unless its capacity is larger."""
SALTS = 64
"""Parts that a language's phrases are ranked in before they are ranked together."""
NO_LANG = "und"

UPPER = bytes(range(ord("A"), ord("Z") + 1))
BREAKS = b".,;:!?\n\x0b\x0c\r"
FLAT = bytes.maketrans(UPPER + BREAKS + b"\t", UPPER.lower() + b"\n" * len(BREAKS) + b" ")
MIX = np.uint64(0x9E3779B97F4A7C15)


# --- words and hashes of a block -----------------------------------------------------------------


def tokens_of(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of all texts, 0 between pieces, and the words; number k is word k - 1."""
    flat = b"\n".join(t.encode("utf-8", "replace") for t in texts).translate(FLAT).replace(b"\n", b" \n ")
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    _ = numbers[b"\n"], numbers[b""]
    raw = flat.split(b" ")
    found = np.fromiter(map(numbers.__getitem__, raw), np.int32, len(raw))
    found = found[found != 1]
    # A number above 1 is a word; a break is kept once.
    kept = np.ones(len(found), bool)
    kept[1:] = (found[1:] != 0) | (found[:-1] != 0)
    found = found[kept]
    return np.where(found > 0, found - 1, 0).astype(np.int32), list(numbers)[2:]


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    """64 bits for each word of a language; the first, for a break, is never used."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
    digest = xxhash.xxh64_intdigest
    return np.array([0, *[digest(w, seed) for w in words]], np.uint64)


def grams(tokens: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hash at each) of the n-grams within pieces, for n from 1 on."""
    h = hashes[tokens]
    whole = tokens > 0
    key, inside = h, whole
    for n in range(1, longest + 1):
        if n > 1:
            if len(key) < 2:
                return
            key = key[:-1] * MIX + h[n - 1 :]
            inside = inside[:-1] & whole[n - 1 :]
        at = np.flatnonzero(inside)
        yield n, at, key[at]


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """Partition (``bits``) and 32 more bits of a hash, as one number."""
    return keys >> np.uint64(32 - bits)


# --- summaries -----------------------------------------------------------------------------------


def _planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted 32-bit keys as gaps, and their counts, by planes of bytes that pack well."""
    gaps = np.diff(keys.astype(np.int64), prepend=0)
    raw = _planes(gaps) + (b"" if counts is None else _planes(np.minimum(counts, 0xFFFFFFFF)))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(packed: bytes, counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    gaps = raw[: len(raw) // 2] if counted else raw
    keys = np.cumsum(_numbers(gaps).astype(np.int64))
    return keys, (_numbers(raw[len(raw) // 2 :]).astype(np.int64) if counted else None)


class MisraGries:
    """Counters of the keys of one partition; a key's count is at most its counter plus ``error``.

    With ``capacity`` c and a whole mass m the error is at most m / (c + 1), however the counts arrive:
    a cut takes the same amount from more than c counters.
    """

    def __init__(self, capacity: int, buffer: int = BUFFER) -> None:
        self.capacity, self.error, self.room = capacity, 0, max(buffer, capacity)
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= self.room:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        if len(keys) > self.capacity:
            taken = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            live = counts > taken
            keys, counts = keys[live], counts[live] - taken
            self.error += int(taken)
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key whose count reaches the threshold, and others that may."""
        self.merge()
        return self.keys[self.counts + self.error >= threshold]


# --- Spark ---------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, lang, n, tokens, words): a row per block and language, stored, so that its numbers stay its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = count()
        waiting: defaultdict[str, list[str]] = defaultdict(list)
        held: defaultdict[str, int] = defaultdict(int)

        def full(lang: str) -> pa.RecordBatch:
            tokens, words = tokens_of(waiting.pop(lang))
            held.pop(lang)
            squeeze = zstandard.ZstdCompressor(level=1).compress
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) + next(made)], pa.int64()),
                    "lang": [lang],
                    "n": pa.array([int(np.count_nonzero(tokens))], pa.int64()),
                    "tokens": pa.array([squeeze(_planes(tokens))], pa.binary()),
                    "words": pa.array([squeeze(b" ".join(words))], pa.binary()),
                }
            )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting[lang].append(text)
                held[lang] += len(text)
                if held[lang] >= block_bytes:
                    yield full(lang)
            # Many languages may wait at once.
            while sum(held.values()) >= 2 * block_bytes:
                yield full(max(held, key=held.__getitem__))
        for lang in list(waiting):
            yield full(lang)

    return stored(docs.mapInArrow(run, "block bigint, lang string, n bigint, tokens binary, words binary"))


def _opened(lang: str, tokens: bytes, words: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    listed = expand(words).split(b" ") if words else []
    listed = [] if listed == [b""] else listed
    return _numbers(expand(tokens)).astype(np.int32), listed, hashes_of(lang, listed)


def _summaries(blocks: DataFrame, bits: int, longest: int) -> DataFrame:
    """(p, block, mass, keys): what each block sends to each hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, tokens, words in zip(*[b.column(x).to_pylist() for x in ("block", "lang", "tokens", "words")]):
                own, _, hashes = _opened(lang, tokens, words)
                keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *[short(k, bits) for _, _, k in grams(own, hashes, longest)]]))
                starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(starts, append=len(keys))
                keys = keys[starts]
                ends = np.searchsorted(keys, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                rows, at = [], 0
                for p, end in enumerate(ends.tolist()):
                    if end > at:
                        rows.append((p, int(counts[at:end].sum()), pack(keys[at:end] & np.uint64(0xFFFFFFFF), counts[at:end])))
                    at = end
                if rows:
                    p, mass, packed = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p, pa.int32()), pa.array([block] * len(p), pa.int64()), pa.array(mass, pa.int64()), pa.array(packed, pa.binary())],
                        ["p", "block", "mass", "keys"],
                    )

    return blocks.select("block", "lang", "tokens", "words").mapInArrow(run, "p int, block bigint, mass bigint, keys binary")


def _remaining(summaries: DataFrame, least: int) -> DataFrame:
    """(block, p, keys): of each block's hashes those that may reach ``least`` occurrences."""

    def run(group: pa.Table) -> pa.Table:
        mass = sum(group["mass"].to_pylist())
        summary = MisraGries(mass // least + 1)
        for packed in group["keys"]:
            summary.add(*unpack(packed.as_py()))
        live = summary.at_least(least)
        p, blocks, kept = group["p"][0].as_py(), [], []
        for block, packed in zip(group["block"], group["keys"]):
            keys, _ = unpack(packed.as_py())
            at = np.searchsorted(live, keys)
            both = keys[live[np.minimum(at, len(live) - 1)] == keys] if len(live) else keys[:0]
            if len(both):
                blocks.append(block.as_py())
                kept.append(pack(both))
        return pa.table({"block": pa.array(blocks, pa.int64()), "p": pa.array([p] * len(blocks), pa.int32()), "keys": pa.array(kept, pa.binary())})

    return summaries.groupBy("p").applyInArrow(run, "block bigint, p int, keys binary")


def _exact(words: list[bytes], tokens: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which of ``at`` it is, phrase, count) of each phrase of ``n`` words that begins there: told apart by words, not hashes."""
    code = tokens[at].astype(np.int64)
    for k in range(1, n):
        _, code = np.unique(code, return_inverse=True)
        code = (code.astype(np.int64) << 32) | tokens[at + k]
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    begins = at[first]
    columns = [[words[i - 1] for i in tokens[begins + k].tolist()] for k in range(n)]
    return first, [b" ".join(x) for x in zip(*columns)], times


def _counted(blocks: DataFrame, remaining: DataFrame, bits: int, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, a) of every phrase that stands ``least`` times.

    Each block counts the phrases whose hashes remain there and sends one row to each hash partition, which adds them up.
    """

    def run(own: pa.Table, kept: pa.Table) -> pa.Table:
        rows = []
        if kept.num_rows:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            live = np.sort(
                np.concatenate(
                    [unpack(k.as_py(), counted=False)[0].astype(np.uint64) | np.uint64(p.as_py() << 32) for p, k in zip(kept["p"], kept["keys"])]
                )
            )
            for lang, packed, listed in zip(*[own[x].to_pylist() for x in ("lang", "tokens", "words")]):
                tokens, words, hashes = _opened(lang, packed, listed)
                parts, phrases, times = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
                for n, at, keys in grams(tokens, hashes, longest):
                    keys = short(keys, bits)
                    place = np.minimum(np.searchsorted(live, keys), len(live) - 1)
                    held = live[place] == keys
                    first, found, a = _exact(words, tokens, at[held], n)
                    parts.append((keys[held][first] >> np.uint64(32)).astype(np.int64))
                    phrases += found
                    times.append(a)
                part, count_ = np.concatenate(parts), np.concatenate(times)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(1 << bits), side="right").tolist()
                for p, (low, high) in enumerate(zip([0, *ends], ends)):
                    if high > low:
                        some = order[low:high]
                        rows.append((p, lang, squeeze(b"\n".join([phrases[i] for i in some.tolist()])), squeeze(_planes(count_[some]))))
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["p", "lang", "phrases", "counts"])

    def total(group: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        sums: defaultdict[str, defaultdict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for lang, phrases, counts in zip(group["lang"], group["phrases"], group["counts"]):
            own = sums[lang.as_py()]
            for phrase, a in zip(expand(phrases.as_py()).split(b"\n"), _numbers(expand(counts.as_py())).tolist()):
                own[phrase] += a
        found = [(lang, phrase, a) for lang, own in sums.items() for phrase, a in own.items() if a >= least]
        return pa.table(
            {
                "lang": pa.array([x[0] for x in found], pa.string()),
                "phrase": pa.array([x[1].decode("utf-8", "replace") for x in found], pa.string()),
                "words": pa.array([x[1].count(b" ") + 1 for x in found], pa.int32()),
                "a": pa.array([x[2] for x in found], pa.int64()),
            }
        )

    sent = (
        blocks.select("block", "lang", "tokens", "words").groupBy("block").cogroup(remaining.groupBy("block"))
        .applyInArrow(run, "p int, lang string, phrases binary, counts binary")
    )
    return sent.groupBy("p").applyInArrow(total, "lang string, phrase string, words int, a bigint")


def frequent(docs: DataFrame, text: str, lang: str, longest: int = LONGEST, least: int = LEAST, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sizes, counts): words of each language, and every phrase of 1 to ``longest`` words with ``least`` occurrences.

    sizes: (lang, n). counts: (lang, phrase, words, a). Texts are lower-cased in A-Z and cut into pieces
    at ``.,;:!?`` and line ends; phrases stay within pieces. A null language is ``und``, a null text empty.
    """
    rows = docs.select(
        F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("b")).first()["b"]
    bits = (max(LEAST_PARTITIONS, -(-size // PARTITION_BYTES)) - 1).bit_length()
    blocks = _blocks(rows, block_bytes)
    remaining = _remaining(_summaries(blocks, bits, longest), least)
    counts = _counted(blocks, remaining, bits, longest, least)
    return blocks.groupBy("lang").agg(F.sum("n").alias("n")), stored(counts)


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array_join(F.slice(words, lit(start), lit(length)), " ")


def _cut(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """Candidates with ``l``, ``r`` and ``score`` of their lowest-scoring cut (the first of equal ones)."""
    w = F.split("phrase", " ")
    sides = [(k, side) for k in range(1, longest) for side in "lr"]
    wanted = F.array(
        *[
            F.when(
                F.col("words") > k,
                F.struct(F.lit(f"{side}{k}").alias("at"), (_part(w, 1, k) if side == "l" else _part(w, k + 1, F.col("words") - k)).alias("part")),
            )
            for k, side in sides
        ]
    )
    parts = candidates.select("lang", "phrase", "words", "a", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("x"))
    # A part stands at least as often as the whole, so it has a row. Crowded parts are split by Spark's skew join.
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    met = parts.select("lang", "phrase", "words", "a", "x.at", "x.part").join(known, ["lang", "part"])
    found = met.groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), *[F.max(F.when(F.col("at") == f"{s}{k}", F.col("f"))).alias(f"{s}{k}") for k, s in sides]
    )
    # Whole numbers beyond 64 bits on the way.
    scored = [
        F.when(
            F.col("words") > k,
            F.struct(
                F.expr(f"(cast({FACTOR} as decimal(8,0)) * cast(a as decimal(20,0))) div cast(l{k} + r{k} as decimal(20,0))").cast("bigint").alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, longest)
    ]
    best = F.array_min(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    return found.select("lang", "phrase", "a", best.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _free(candidates: DataFrame, longest: int, share: int) -> DataFrame:
    """Candidates without those that lie inside a longer one standing in ``share`` percent of their places."""
    w = F.split("phrase", " ")
    inner = [F.when(F.col("words") >= start + n - 1, _part(w, start, n)) for n in range(2, longest) for start in range(1, longest - n + 2)]
    if not inner:
        return candidates
    longer = candidates.where(F.col("words") > 2).select("lang", F.col("phrase").alias("whole"), "a", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
    most = longer.where(F.col("phrase") != F.col("whole")).groupBy("lang", "phrase").agg(F.max("a").alias("f"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * share)).drop("f")


def find_phrases(
    docs: DataFrame, text: str, lang: str, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, block_bytes: int = BLOCK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Candidates are phrases of 2 to ``longest`` words with ``least`` occurrences (see ``frequent``). A phrase scores
    ``FACTOR`` * a / (l + r), cut to a whole number, at the cut where this is least; ``l`` and ``r`` are the
    occurrences of the two parts. Phrases inside a longer candidate that holds ``share`` percent of their
    occurrences go. Order: score and ``a`` descending, then the phrase by its bytes. Repeated rows count as often
    as they stand; an empty table, or one of empty texts, has no phrases. Only the two columns named are read.
    """
    sizes, counts = frequent(docs, text, lang, longest, least, block_bytes)
    candidates = counts.where(F.col("words") > 1)
    scored = _cut(_free(candidates, longest, share), counts, longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language may hold most phrases: each part of it is ranked first.
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language of the documents."""
    return find_phrases(table(spark, sf_dir, "documents"), "text", "lang")


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, " + " || ' ' || ".join(["w", *[f"w{k}" for k in range(1, n)]]) + " AS phrase FROM near"
        + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "")
        for n in range(1, LONGEST + 1)
    )
    leads = ", ".join(f"lead(w, {k}) OVER piece AS w{k}" for k in range(1, LONGEST))
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS id, coalesce(lang, '{NO_LANG}') AS lang, {lower} AS t FROM documents),
    pieces AS (
        SELECT id, lang, unnest(p) AS piece, unnest(range(len(p))) AS pn
        FROM (SELECT id, lang, regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\x0C\\r]') AS p FROM texts)
    ),
    tokens AS (
        SELECT id, lang, pn, unnest(ws) AS w, unnest(range(len(ws))) AS i
        FROM (SELECT id, lang, pn, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM pieces)
    ),
    near AS (SELECT lang, w, {leads} FROM tokens WINDOW piece AS (PARTITION BY id, pn ORDER BY i)),
    sizes AS (SELECT lang, count(*) AS n FROM tokens GROUP BY lang),
    counts AS (SELECT lang, phrase, words, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
    candidates AS (SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
    cuts AS (
        SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)
    ),
    scores AS (
        SELECT c.lang, c.phrase, c.words, c.a, c.k, x.a AS l, y.a AS r, ({FACTOR}::HUGEINT * c.a) // (x.a + y.a) AS score
        FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
    ),
    lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_phrases AS (
        SELECT lang, a, words, array_to_string(w[s:s + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(2, words)) AS m FROM candidates) CROSS JOIN LATERAL (SELECT unnest(range(1, words - m + 2)) AS s)
    ),
    longer AS (SELECT lang, phrase, max(a) AS f FROM inner_phrases GROUP BY lang, phrase),
    kept AS (
        SELECT c.* FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
        WHERE g.f IS NULL OR 100 * g.f < {SHARE} * c.a
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}
    """


OP11_SQL = _sql()
