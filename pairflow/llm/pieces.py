"""SentencePiece encoding and decoding by a max-plus scan.

A text's segmentation into pieces is the one of greatest score sum. Texts are cut into chunks of a
fixed length; what a chunk does to the scores is a small matrix over the states at its two ends
(how far a piece reaches over the boundary). Matrices of a text are combined by an associative
max-plus product in a doubling scan, that fixes the states at all boundaries, and then every chunk
is traced back by itself. So a text of any length is spread over many tasks; a text of at most one
chunk needs no matrix.

The piece file gives the vocabulary and its order of merit; a piece's score is the logarithm of
1 / (merit + 10), in whole millionths, so that sums are exact and equal in every order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.llm.common import columns, quoted, spare, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 65_536
"""Characters of a chunk."""
CACHE, CACHED, TAIL = 250_000, 48, 8
"""Parts whose pieces a task remembers, their greatest length, and that of the ends it remembers; only a matter of speed."""
BATCH_CHARS = 2_000_000
"""Characters that a task works on at once; only a matter of memory."""
LOST = -(10**15)
"""Score of what cannot be."""
UNIT = 1_000_000


@dataclass
class Vocabulary:
    """Pieces with their scores, as plain data that is sent to every task (its size is that of the model file)."""

    pieces: list[str]
    scores: list[int]
    byte_ids: list[int]
    unknown: int
    _trie: dict | None = field(default=None, repr=False)
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def longest(self) -> int:
        return max(1, *(len(p) for p in self.pieces if p))

    @property
    def reach(self) -> int:
        """States at a boundary: a piece reaches over it by 0 to this many characters less one."""
        return self.longest

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_trie": None, "_cache": {}}

    def trie(self) -> dict:
        if self._trie is None:
            root: dict = {}
            for i, p in enumerate(self.pieces):
                node = root
                for c in p:
                    node = node.setdefault(c, {})
                if p:
                    node[""] = (i, self.scores[i], np.int32(i).tobytes())
            self._trie = root
        return self._trie


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file; control and byte pieces match no text by themselves."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces, scores, byte_ids = [""] * n, [0] * n, [-1] * 256
    merit = 0
    for i in range(n):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            _check(piece)
            pieces[i], scores[i] = piece, -round(UNIT * math.log(merit + 10))
            merit += 1
    if min(byte_ids) < 0:
        raise ValueError("the model has no piece for every byte")
    return Vocabulary(pieces, scores, byte_ids, min(scores) - 10 * UNIT)


# --- one text in one task ----------------------------------------------------------------------

_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PARTS = re.compile(f"{SPACE}*(?:[{_LATIN}]+|[^{_LATIN}{SPACE}]+)|{SPACE}+")


def _words(s: str) -> list[str]:
    """Parts that no piece crosses: space marks begin one, and Latin letters share none with other characters."""
    return _PARTS.findall(s)


def _check(piece: str) -> None:
    """A piece must lie in one part, or cutting texts into parts would lose segmentations."""
    if len(_words(piece)) != 1:
        raise ValueError(f"the piece {piece!r} joins parts that are worked out apart")


class _Cache(dict):
    """Part to the ids (int32) of its best segmentation, worked out when missing.

    The best segmentation of a text is its best first piece and the best of the rest; of equal ones
    the one with the longest first piece is taken. Short ends, which many words share, are
    remembered with their scores. A full store begins anew, but for what is asked again.
    """

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v, self.root = v, v.trie()
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, tuple[int, bytes]] = {"": (0, b"")}

    def __missing__(self, s: str) -> bytes:
        ids = self.before.get(s)
        if ids is None:
            ids = self._tail(s)[1] if len(s) <= TAIL else self._work(s)
        if len(s) <= CACHED:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[s] = ids
        return ids

    def _bytes(self, c: str) -> bytes:
        return np.array([self.v.byte_ids[b] for b in c.encode("utf-8", "replace")], np.int32).tobytes()

    def _tail(self, s: str) -> tuple[int, bytes]:
        tails, node, best, first, rest = self.tails, self.root, None, b"", b""
        found = tails.get(s)
        if found is not None:
            return found
        for j, c in enumerate(s, 1):
            node = node.get(c)
            if node is None:
                break
            end = node.get("")
            if end is not None:
                after = tails.get(s[j:]) or self._tail(s[j:])
                x = end[1] + after[0]
                if best is None or x >= best:
                    best, first, rest = x, end[2], after[1]
            elif j == 1:
                after = self._tail(s[1:])
                best, first, rest = self.v.unknown + after[0], self._bytes(s[0]), after[1]
        if best is None:
            after = self._tail(s[1:])
            best, first, rest = self.v.unknown + after[0], self._bytes(s[0]), after[1]
        if len(tails) >= CACHE // 2:
            tails.clear()
            tails[""] = (0, b"")
        tails[s] = found = best, first + rest
        return found

    def _work(self, s: str) -> bytes:
        """From the end to the start; the last few characters are a tail."""
        n = len(s)
        m = n - TAIL
        score: list[int] = [0] * (n + 1)
        step: list[tuple] = [()] * m
        ends: list[bytes] = [b""] * (TAIL + 1)
        for j in range(m, n):
            score[j], ends[j - m] = self._tail(s[j:])
        unknown, root = self.v.unknown, self.root
        for i in range(m - 1, -1, -1):
            node, j, best, found = root, i, unknown + score[i + 1], None
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                end = node.get("")
                if end is not None:
                    x = end[1] + score[j]
                    if x >= best:
                        best, found = x, (end[2], j)
            score[i], step[i] = best, found or (self._bytes(s[i]), i + 1)
        out, i = [], 0
        while i < m:
            ids, i = step[i]
            out.append(ids)
        out.append(ends[i - m])
        return b"".join(out)


def _cache(v: Vocabulary) -> _Cache:
    if "words" not in v._cache:
        v._cache["words"] = _Cache(v)
    return v._cache["words"]


def encode_ids(v: Vocabulary, s: str) -> bytes:
    """Ids (int32) of a text whose spaces are already marks."""
    return b"".join(map(_cache(v).__getitem__, _words(s)))


def score_ids(v: Vocabulary, ids: np.ndarray) -> int:
    """Sum of the pieces' scores; a character written in bytes counts once, at its first byte."""
    if "scores" not in v._cache:
        scores = np.array(v.scores, np.int64)
        for b, i in enumerate(v.byte_ids):
            scores[i] = 0 if 0x80 <= b < 0xC0 else v.unknown
        v._cache["scores"] = scores
    return int(v._cache["scores"][ids].sum())


def encode_part(v: Vocabulary, s: str) -> tuple[int, bytes]:
    """Score and ids of a text whose spaces are already marks."""
    ids = encode_ids(v, s)
    return score_ids(v, np.frombuffer(ids, np.int32)), ids


def marked(text: str) -> str:
    """Spaces become marks, and one goes ahead of the text; the empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text that ``ids`` stand for: byte runs are read as UTF-8, marks are spaces, the first of them goes."""
    if "bytes" not in v._cache:
        parts = [p.encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            parts[i] = bytes([b])
        v._cache["bytes"] = parts
    parts = v._cache["bytes"]
    whole = b"".join(map(parts.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return whole[1:] if whole.startswith(" ") else whole


# --- a chunk and its matrix --------------------------------------------------------------------


def _forward(v: Vocabulary, s: str, start: int, length: int) -> np.ndarray:
    """Best score from ``start`` to each state: a token ends ``j`` characters past ``length``, and none earlier past it."""
    out = np.full(v.reach, LOST, np.int64)
    if start >= length:
        out[start - length] = 0
        return out
    root = v.trie()
    score = {start: 0}
    for i in range(start, length):
        at = score.pop(i, None)
        if at is None:
            continue
        if (x := at + v.unknown) > score.get(i + 1, 2 * LOST):
            score[i + 1] = x
        node, j = root, i
        while j < len(s) and (node := node.get(s[j])) is not None:
            j += 1
            if (end := node.get("")) is not None and (x := at + end[1]) > score.get(j, 2 * LOST):
                score[j] = x
    for j, x in score.items():
        out[j - length] = x
    return out


def _score(v: Vocabulary, s: str) -> int:
    return encode_part(v, s)[0]


def transfer(v: Vocabulary, s: str, length: int) -> np.ndarray:
    """Matrix (entry state, exit state) of a chunk: ``s`` is its ``length`` characters and what a piece may reach past them.

    Where every segmentation passes between two words, entry and exit do not depend on each other
    and the matrix is an outer sum; a chunk inside one giant word takes a pass per entry state.
    """
    states = v.reach
    lead = min(length, states)
    parts = _words(s[:length])
    ends = np.cumsum([len(p) for p in parts])
    # Cuts between words; the last part may go on past the chunk, so its end is no cut.
    cuts = [int(c) for c in ends[:-1] if c >= lead]
    if not cuts:
        return np.stack([_forward(v, s, i, length) if i <= length else np.full(states, LOST, np.int64) for i in range(states)])
    first, last = cuts[0], cuts[-1]
    entry = np.array([_score(v, s[i:first]) if i <= first else LOST for i in range(states)], np.int64)
    middle = _score(v, s[first:last])
    out = entry[:, None] + (middle + _forward(v, s, last, length))[None, :]
    return np.maximum(out, LOST)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), LOST)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... n matrices, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def scores_after(matrices: np.ndarray) -> tuple[np.ndarray, int]:
    """Best score from each state behind each chunk to the end of the text, and the score of the whole text."""
    states = matrices.shape[1]
    end = np.where(np.arange(states) == 0, 0, LOST)
    # Products of the last 1, 2, ... n chunks: a product turned round is that of the turned matrices.
    ends = scan(matrices[::-1].transpose(0, 2, 1))[:, 0, :]
    return np.concatenate([ends[-2::-1], end[None, :]]), int(ends[-1][0])


def loose_end(v: Vocabulary, s: str, length: int) -> tuple[int, bool]:
    """Where the last part of a chunk begins, and whether every segmentation passes there (0 and not so without a cut)."""
    lead = min(length, v.reach)
    ends = np.cumsum([len(p) for p in _words(s[:length])])
    cuts = [int(c) for c in ends[:-1] if c >= lead]
    return (cuts[-1], True) if cuts else (0, False)


def exit_states(v: Vocabulary, tail: str, length: int, after: np.ndarray, passed: bool) -> np.ndarray:
    """State behind a chunk for each state before it, on the best path to the end of the text.

    ``tail`` is the chunk from its loose end on, ``length`` characters and what a piece may reach past
    them; ``after`` holds the scores from there. Of equally good paths the one with the longest first
    piece is followed, as within a part, so the path does not depend on where texts are cut.
    """
    states, root, unknown = v.reach, v.trie(), v.unknown
    score = [0] * length + [int(x) for x in after]
    leaves = [0] * length
    for i in range(length - 1, -1, -1):
        node, j, best, to = root, i, unknown + score[i + 1], i + 1
        while j < len(tail) and (node := node.get(tail[j])) is not None:
            j += 1
            if (end := node.get("")) is not None and (x := end[1] + score[j]) >= best:
                best, to = x, j
        score[i] = best
        leaves[i] = leaves[to] if to < length else to - length
    if passed:
        return np.full(states, leaves[0], np.int32)
    return np.array([leaves[e] if e < length else e - length for e in range(states)], np.int32)


def followed(exits: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk, from state 0 on."""
    out, state = [], 0
    for e in exits:
        out.append((state, int(e[state])))
        state = out[-1][1]
    return out


# --- Spark -------------------------------------------------------------------------------------


def _lists(ids: list[bytes]) -> pa.Array:
    lengths = np.fromiter((len(b) // 4 for b in ids), np.int64, len(ids))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat = pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32())
    if offsets[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
    raise ValueError("more than 2 to the 31 pieces in one batch")


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_CHARS`` characters (or pieces) of ``column``, one row at least."""
    import pyarrow.compute as pc

    for b in batches:
        values = b.column(b.schema.get_field_index(column))
        length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BATCH_CHARS, "right")))
            yield b.slice(at, to - at)
            at = to


def _appended(schema: T.StructType, *more: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *more])


def encode(
    docs: DataFrame,
    text: str = "text",
    vocabulary: Vocabulary | None = None,
    ids: str = "ids",
    score: str = "score",
    chunk: int = CHUNK,
    restored: str | None = None,
) -> DataFrame:
    """Each row of ``docs`` with its piece ids (array<int>) and their score (bigint, millionths).

    With ``restored`` the ids are decoded at once, where they are, and a column of that name tells
    whether the text came back (with a space for each mark U+2581 it held).

    A null or empty text has no pieces and score 0. A character that no piece matches gives its
    UTF-8 bytes. Of equally good segmentations that with the longest first piece comes out, and so on
    from there, whatever the chunk length. Repeated texts longer than a chunk are worked out once; all rows come back.
    An empty table gives an empty one. Columns of ``docs`` named like the results are replaced.
    """
    v = vocabulary or load()
    names = [ids, score, *([restored] if restored else [])]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    length = F.coalesce(F.length(F.col(quoted(text))), F.lit(0))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(score, T.LongType())]
    added += [T.StructField(restored, T.BooleanType())] if restored else []

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, text):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            found = [encode_ids(v, marked(t)) for t in texts]
            sums = pa.array([score_ids(v, np.frombuffer(i, np.int32)) for i in found], pa.int64())
            back = [decode_ids(v, np.frombuffer(i, np.int32)) == t.replace(SPACE, " ") for i, t in zip(found, texts)] if restored else []
            made = [_lists(found), sums, *([pa.array(back, pa.bool_())] if restored else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    short = docs.where(length < chunk).mapInArrow(direct, _appended(docs.schema, *added))
    (sha,) = spare(docs, "sha")
    long = docs.where(length >= chunk).withColumn(sha, F.sha2(F.col(quoted(text)).cast("binary"), 256))
    texts = long.select(F.col(sha).alias("sha"), F.col(quoted(text)).alias("text")).dropDuplicates(["sha"])
    done = _encode_long(texts, v, chunk).select(F.col("sha").alias(sha), F.col("ids").alias(ids), F.col("score").alias(score))
    whole = long.join(done, sha).drop(sha)
    if restored:
        (decoded,) = spare(whole, "decoded")
        whole = decode(whole, ids, v, decoded).withColumn(
            restored, F.col(decoded) == F.replace(F.col(quoted(text)), F.lit(SPACE), F.lit(" "))
        ).drop(decoded)
    return short.unionByName(whole)


def _encode_long(texts: DataFrame, v: Vocabulary, chunk: int) -> DataFrame:
    """(sha, ids, score) for the distinct long ``texts`` (sha, text), chunk by chunk."""
    reach = v.reach - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sha, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = marked(text)
                starts = range(0, len(s), chunk)
                for few in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([sha] * len(few)),
                            pa.array([i // chunk for i in few], pa.int64()),
                            pa.array([min(chunk, len(s) - i) for i in few], pa.int32()),
                            pa.array([s[i : i + chunk + reach] for i in few]),
                        ],
                        ["sha", "chunk", "length", "part"],
                    )

    chunks = stored(
        texts.mapInArrow(cut, "sha string, chunk bigint, length int, part string").repartition("sha", "chunk")
    )

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(3).to_pylist(), b.column(2).to_pylist()))
            made = [transfer(v, s, n).tobytes() for s, n in rows]
            loose = [loose_end(v, s, n) for s, n in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(made, pa.binary()),
                    pa.array([s[at:] for (s, _), (at, _) in zip(rows, loose)]),
                    pa.array([n - at for (_, n), (at, _) in zip(rows, loose)], pa.int32()),
                    pa.array([passed for _, passed in loose]),
                ],
                ["sha", "chunk", "m", "tail", "left", "passed"],
            )

    def suffixes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        m = np.stack([np.frombuffer(x, np.int64).reshape(v.reach, v.reach) for x in group["m"]])
        after, total = scores_after(m)
        return pd.DataFrame({"sha": group["sha"], "chunk": group["chunk"], "after": [a.tobytes() for a in after], "score": total})

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in range(3, 7)))
            found = [exit_states(v, s, n, np.frombuffer(after, np.int64), passed).tobytes() for s, n, passed, after in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], ["sha", "chunk", "score", "exits"])

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = followed([np.frombuffer(x, np.int32) for x in group["exits"]])
        return pd.DataFrame(
            {"sha": group["sha"], "chunk": group["chunk"], "entry": [a for a, _ in found], "exit": [b for _, b in found], "score": group["score"]}
        )

    # One text's matrices and states take a few kilobytes a chunk, far less than the text, which was one row.
    # A loose end is a part of a word, but for words longer than a chunk; it is met with the scores behind it.
    ends = stored(chunks.mapInArrow(matrix, "sha string, chunk bigint, m binary, tail string, left int, passed boolean"))
    behind = ends.select("sha", "chunk", "m").groupBy("sha").applyInPandas(suffixes, "sha string, chunk bigint, after binary, score bigint")
    paths = (
        ends.drop("m")
        .join(behind, ["sha", "chunk"])
        .select("sha", "chunk", "score", "tail", "left", "passed", "after")
        .mapInArrow(leave, "sha string, chunk bigint, score bigint, exits binary")
        .groupBy("sha")
        .applyInPandas(states, "sha string, chunk bigint, entry int, exit int, score bigint")
    )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in range(2, 6)))
            made = [encode_ids(v, part[entry : n + exit_]) for n, part, entry, exit_ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), _lists(made)], ["sha", "chunk", "score", "ids"])

    traced = (
        chunks.join(paths, ["sha", "chunk"])
        .select("sha", "chunk", "length", "part", "entry", "exit", "score")
        .mapInArrow(trace, "sha string, chunk bigint, score bigint, ids array<int>")
    )
    return traced.groupBy("sha").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"),
        F.first("score").alias("score"),
    )


def decode(docs: DataFrame, ids: str = "ids", vocabulary: Vocabulary | None = None, into: str = "decoded") -> DataFrame:
    """Each row of ``docs`` with the text of its ids; null ids give the empty text.

    Encoding and decoding give a text back exactly, but for the mark U+2581 itself, which comes back as a space.
    """
    v = vocabulary or load()
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, ids):
            lists = b.column(b.schema.get_field_index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)).tolist()
            texts = [decode_ids(v, flat[a:z]) for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    return docs.mapInArrow(back, _appended(docs.schema, T.StructField(into, T.StringType())))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again and compared: ids, their number and score, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encode(docs, restored="restored")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "score", "restored", "ids")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every row with ``ids``, ``n_pieces`` and ``restored`` (the ids give the text back)."""
    (score,) = spare(docs, "score")
    made = encode(docs, score=score, restored="restored").drop(score)
    return made.select(*columns(docs), "ids", F.size("ids").cast("bigint").alias("n_pieces"), "restored")
