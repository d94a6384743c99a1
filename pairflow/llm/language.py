"""The language of texts, and of the spans of texts in several languages.

Every language is learnt as the shares of letter sequences (one to four characters, word edges included) in
labelled texts, and as the scripts its letters belong to. In a text each word is scored for the languages that write in
its script, and the best path over the words (Viterbi; each change of language costs a penalty) labels spans.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, row_key, table

SAMPLE = 4000
"""Labelled texts of each language that are learnt from, on average; whole texts, drawn by a digest of the row."""
BUCKETS = 1 << 17
"""Shares kept for a language: sequences of letters are told apart by a digest of so many values."""
ORDER = 4
"""Characters of the longest sequence."""
PENALTY = 8.0
"""What a change of language costs, in natural logarithms of probability."""
SMOOTH = 0.5
SCRIPT_SHARE = 0.01
"""Share of a language's letters from which a script is one of its own."""
SLICE = 1_000_000
"""Numbers (letters times languages) that are scored at once."""
NONE = "und"

# Code points from which a script's block begins; 0 stands for what no script here claims.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"),
    (0x3100, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "katakana"),
    (0xFFA0, "hangul"), (0xFFDD, "other"), (0x20000, "han"), (0x323B0, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(folded, script) of every code point: its lower-case form and 1 + its script; both 0 where it is no letter."""
    folded = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            folded[code] = ord(low) if len(low) == 1 else code
    starts, numbers = [s for s, _ in SCRIPTS], np.array([1 + NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    script = numbers[np.searchsorted(starts, np.arange(len(folded)), side="right") - 1]
    return folded, np.where(folded > 0, script, 0).astype(np.uint8)


@dataclass
class Words:
    """The words (runs of letters) of several texts, one after the other."""

    letters: np.ndarray  # folded letters of all words, each word between zeros
    at: np.ndarray  # place of each word's first letter in ``letters``
    length: np.ndarray
    script: np.ndarray  # of each word's first letter
    start: np.ndarray  # code point of its text that a word begins at
    text: np.ndarray  # which text it is of

    @staticmethod
    def of(texts: list[str]) -> Words:
        folded, scripts = _tables()
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        # Texts are parted by a code that is no letter.
        raw = np.concatenate([np.zeros(1, np.uint32), *[x for c in codes for x in (c, np.zeros(1, np.uint32))]])
        low = folded[raw]
        is_letter = low > 0
        first = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
        end = np.flatnonzero(is_letter[:-1] & ~is_letter[1:]) + 1
        length = end - first
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        text = np.searchsorted(begins, first, side="right") - 1
        # One zero between words: letters, and the first of what follows each word.
        kept = is_letter.copy()
        kept[end] = True
        kept[0] = True
        places = np.cumsum(kept) - 1
        return Words(low[kept], places[first], length, scripts[raw[first]], first - begins[text], text)


def features(letters: np.ndarray, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """(order, places): the digest of the sequence of n characters that ends at each place, for n from 1 to ``order``.

    A sequence that would reach beyond the zero ahead of its word ends there: it is the one from that zero on.
    """
    x = letters.astype(np.uint64)
    out = np.zeros((order, len(x)), np.int32)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (buckets - 1).bit_length())
    key = x + np.uint64(1)
    inside = np.ones(len(x), bool)
    out[0] = (key * mix >> shift).astype(np.int32)
    for n in range(2, order + 1):
        back = np.zeros(len(x), np.uint64)
        back[n - 1 :] = x[: max(0, len(x) - n + 1)]
        key = np.where(inside, (key * mix) ^ (back + np.uint64(n << 32)), key)
        inside &= back > 0
        out[n - 1] = (key * mix >> shift).astype(np.int32)
    return out


@dataclass
class Model:
    """What was learnt: names of the languages, log shares (bucket, language), scripts each writes in."""

    names: list[str]
    logs: np.ndarray
    writes: np.ndarray  # (script, language)

    def scores(self, words: Words) -> np.ndarray:
        """(word, language): mean log share over the orders, summed over the letters of a word and its end; -inf outside the script."""
        n, own = len(words.at), len(self.names)
        out = np.zeros((n, own), np.float32)
        step = max(1, SLICE // max(1, own))
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(words.at, words.at[at] + step, side="right")))
            low, high = int(words.at[at]) - 1, int(words.at[stop - 1] + words.length[stop - 1]) + 1
            begin, some = words.at[at:stop] - low, np.zeros((high - low, own), np.float32)
            for row in features(words.letters[low:high]):
                some += self.logs[row]
            # The zero behind a word is its end; the one ahead of the first word is nobody's.
            out[at:stop] = np.add.reduceat(some, begin, axis=0) / ORDER
            at = stop
        writes = self.writes[words.script]
        # A script that no language was seen in leaves all of them.
        writes = writes | ~writes.any(1, keepdims=True)
        return np.where(writes, out, np.float32(-1e9))


def paths(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; ``sizes`` are the words of each text, in order. Ties go to the first language.

    Texts are walked side by side, those of like length together, so a long one holds no others up.
    """
    out = np.zeros(len(scores), np.int16)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        group = order[at : at + max(1, min(4096, 4_000_000 // longest))]
        at += len(group)
        _walk(scores, begins[group], sizes[group], penalty, out)
    return out


def _walk(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, penalty: float, out: np.ndarray) -> None:
    steps, width = int(sizes[0]), len(sizes)
    running = np.searchsorted(-sizes, -np.arange(steps), side="left")
    stays = np.zeros((steps, width, scores.shape[1]), bool)  # whether the best way to a language comes from itself
    best = np.zeros((steps, width), np.int16)  # the best language one word before
    state = np.zeros((width, scores.shape[1]), np.float32)
    last = np.zeros(width, np.int16)
    for t in range(steps):
        n = running[t]
        live = state[:n]
        if t:
            top = live.argmax(1)
            live -= live[np.arange(n), top][:, None]  # only differences count, and they stay small
            best[t, :n] = top
            keep = live >= -penalty
            stays[t, :n] = keep
            np.maximum(live, -penalty, out=live)
        live += scores[begins[:n] + t]
        done = sizes[:n] == t + 1
        if done.any():
            last[:n][done] = live[done].argmax(1)
    rows = np.arange(width)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        here = last[:n]
        out[begins[:n] + t] = here
        if t:
            last[:n] = np.where(stays[t, rows[:n], here], here, best[t, :n])


# --- Spark ---------------------------------------------------------------------------------------


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, kind, bucket, n): counts of sequences (kind 0) and of letters by script (kind 1), summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams, scripts = held.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES) + 1, np.int64)))
                for text in texts:
                    words = Words.of([text])
                    for a in range(0, len(words.letters), 4 * SLICE):
                        # Sequences reach back over the cut; those that end before it were counted.
                        low = max(0, a - ORDER)
                        for row in features(words.letters[low : a + 4 * SLICE]):
                            grams += np.bincount(row[max(a, 1) - low :], minlength=BUCKETS)
                    scripts += np.bincount(words.script, words.length, minlength=len(scripts)).astype(np.int64)
        for lang, both in held.items():
            for kind, n in enumerate(both):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                    ["lang", "kind", "bucket", "n"],
                )

    counted = sample.mapInArrow(run, "lang string, kind int, bucket int, n bigint")
    return counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled ``rows`` (lang, text, key), from about ``sample`` texts of each language.

    A text is taken by its digest ``key``, so that a rerun takes the same ones. The driver holds ``BUCKETS`` shares a language.
    """
    labelled = rows.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    # Languages are few: one row each. Keys are spread evenly, so a part of them holds that part of the texts.
    share = {r["lang"]: sample / r["texts"] for r in sizes.collect()}
    if not share:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES) + 1, 0), bool))
    limit = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(min(1.0, s) * (1 << 32)))])
    taken = labelled.where(F.pmod("key", F.lit(1 << 32)) < F.element_at(limit, F.col("lang"))).select("lang", "text")
    found = _counted(taken).toPandas()
    names = sorted(share)
    number = found["lang"].map({lang: i for i, lang in enumerate(names)}).to_numpy(np.int64)
    grams, scripts = np.zeros((BUCKETS, len(names))), np.zeros((len(NAMES) + 1, len(names)))
    for kind, out in enumerate((grams, scripts)):
        own = (found["kind"] == kind).to_numpy()
        out[found["bucket"].to_numpy()[own], number[own]] = found["n"].to_numpy()[own]
    # Each language is smoothed towards what all share.
    even = (grams / np.maximum(1, grams.sum(0))).mean(1, keepdims=True) * 0.9 + 0.1 / BUCKETS
    weight = SMOOTH * BUCKETS * 0.01
    logs = np.log((grams + weight * even) / (grams.sum(0) + weight))
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    return Model(names, logs.astype(np.float32), writes & (scripts > 0))


def label_texts(docs: DataFrame, id_: str, text: str, lang: str, held_out: Column, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """(id, held_out, lang_pred, score, n_words, spans): one row per row of ``docs``.

    Learns from rows that are not ``held_out`` and have text and language; no label is used in a prediction.
    ``spans`` lists (start, end, lang): code points, end exclusive, from a span's first letter to its last. ``lang_pred`` is
    the language of most letters (ties: the first by name), ``score`` their share of all letters. A null text, one
    without letters, or one where nothing was learnt is ``und`` with score 0 and no spans. Ids are kept as they
    are, null and repeated ones too.
    """
    rows = docs.select(
        F.col(quoted(id_)).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(quoted(lang)).cast("string").alias("lang"),
        F.col(quoted(text)).alias("text"),
        row_key(docs, id_, text).alias("key"),
    )
    shipped = docs.sparkSession.sparkContext.broadcast(learn(rows.where("not held_out"), sample))
    kind = rows.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(texts: list[str], model: Model) -> tuple[list[str], list[float], list[int], list[list[dict]]]:
        n = len(texts)
        pred, share, counts, spans = [NONE] * n, [0.0] * n, [0] * n, [[] for _ in texts]
        words = Words.of(texts)
        sizes = np.bincount(words.text, minlength=n)
        if not model.names or not len(words.at):
            return pred, share, sizes.tolist(), spans
        path = paths(model.scores(words), sizes, penalty)
        own = len(model.names)
        letters = np.bincount(words.text * own + path, words.length, minlength=n * own).reshape(n, own)
        whole = letters.sum(1)
        top = letters.argmax(1)
        for i in np.flatnonzero(whole).tolist():
            pred[i], share[i] = model.names[top[i]], float(letters[i, top[i]] / whole[i])
        edge = np.ones(len(path), bool)
        edge[1:] = (path[1:] != path[:-1]) | (words.text[1:] != words.text[:-1])
        first = np.flatnonzero(edge)
        final = np.append(first[1:], len(path)) - 1
        ends = words.start[final] + words.length[final]
        for i, a, b, k in zip(words.text[first].tolist(), words.start[first].tolist(), ends.tolist(), path[first].tolist()):
            spans[i].append({"start": a, "end": b, "lang": model.names[k]})
        return pred, share, sizes.tolist(), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            # Whole texts, as many as make about a slice; a long one stands alone.
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE):
                    size += len(texts[stop])
                    stop += 1
                pred, share, counts, spans = label(texts[at:stop], model)
                ids, held = b.column(0).slice(at, stop - at), b.column(1).slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, spans_type)],
                    ["id", "held_out", "lang_pred", "score", "n_words", "spans"],
                )
                at = stop

    schema = f"id {kind}, held_out boolean, lang_pred string, score double, n_words bigint, spans array<struct<start:bigint,end:bigint,lang:string>>"
    return rows.select("id", "held_out", "text").mapInArrow(run, schema).withColumnRenamed("id", id_)


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them; ``spans`` as lang:start:end, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = label_texts(docs, "doc_id", "text", "lang", held_out)
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_words", F.array_join(spans, ",").alias("spans"))
