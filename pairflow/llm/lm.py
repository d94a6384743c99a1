"""A hidden Markov language model of word classes, and the likelihood of whole texts under it.

Latent states emit each word that the training texts hold often enough, so that the emission table
grows with their vocabulary. Of rarer words they emit one of a fixed number of classes, a digest of the word,
and the class emits the word in proportion to its training count. Baum-Welch counts are gathered by
every task over its own texts and summed by Spark; the driver only ever holds what is shared
(states x classes). The words' own emissions never meet in one place: words are dealt to parts by a digest,
a block of texts numbers its words part by part, and in each round sends every part the expected counts
of its words, as one packed row in a fixed order. The part adds them up word by word and sends each block
its emissions back in the same order, so that no word, number or key of a word travels after the first count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, shared_path, swept_shuffles, table
from pairflow.session import delete

STATES, CLASSES, ROUNDS = 8, 4096, 10
OFTEN = 8
"""Training tokens from which a word is emitted by itself and not by its class, whatever the size of the input."""
SEGMENT = 2048
"""Tokens of a text walked in one go; longer texts are walked in segments side by side, with the same result."""
GROUP, CELLS = 2048, 1 << 20
"""Sequences worked on side by side, and the places of their padded matrix (a longer sequence is alone)."""
BLOCK_BYTES = 48_000_000
"""Bytes of text of a block about; half as many more at most, unless one Arrow batch holds more."""
PARTS, PART_BYTES = 64, 64_000_000
"""Parts of the vocabulary: so many at least, one more for so many bytes of text."""
PRIOR = 0.5
"""Pseudo-counts of each class in each state, split by the classes' own shares."""
SEED = 7


def word_class(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word) % classes


@dataclass
class Model:
    """Probabilities: start of a text, transitions, emissions (class, state)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def initial(shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """Sticky states whose emissions are the shares, unlike each other by chance."""
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * rng.gamma(0.5, 2.0, (len(shares), states)) + 1e-3 * shares[:, None]
        step = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * 0.95
        return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


# --- numpy over many sequences at once -----------------------------------------------------------


def groups(sequences: list[np.ndarray], most: int = GROUP, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Places of the sequences by falling length, in groups whose padded matrix is bounded."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        width = max(1, min(most, cells // max(1, int(lengths[order[at]]))))
        yield order[at : at + width]
        at += width


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as columns of one matrix; and how many are still running at each step."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths[0], len(sequences)), np.int32)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    return out, running


def _by_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of sequences, longest first: the first of each, then the second of each that has one, and so on; where each step begins."""
    lengths = np.array([len(s) for s in sequences])
    flat, starts = np.concatenate(sequences).astype(np.intp), np.cumsum(lengths) - lengths
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    bounds = np.append(0, np.cumsum(running))
    out = np.empty(len(flat), np.intp)
    for t, n in enumerate(running):
        flat.take(starts[:n] + t, out=out[bounds[t] : bounds[t + 1]], mode="clip")
    return out, bounds


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion over each whole sequence."""
    result, one = np.zeros(len(sequences)), np.ones(len(model.first))
    for own in groups(sequences, 4 * GROUP, 4 * CELLS):
        tokens, running = _padded([sequences[i] for i in own])
        total, a = np.zeros(len(own)), None
        for t in range(len(tokens)):
            n = running[t]
            e = model.emit.take(tokens[t, :n], axis=0)
            a = e * model.first if a is None else (a[:n] @ model.step) * e
            scale = a @ one
            a *= 1 / scale[:, None]
            total[:n] += np.log10(scale)
        result[own] = total
    return result


def segments(tokens: np.ndarray, length: int = SEGMENT) -> list[np.ndarray]:
    return [tokens[i : i + length] for i in range(0, len(tokens), length)]


def transfers(emit: np.ndarray, step: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
    """For each piece and state at its first token, what flows to each state at its last one, up to a factor of the piece.

    ``emit`` has a row a state here.
    """
    states = len(step)
    out = np.zeros((len(pieces), states, states))
    forth = np.ascontiguousarray(step.T)
    for own in groups(pieces, GROUP // 4, CELLS):
        symbols, bounds = _by_step([pieces[i] for i in own])
        emitted = emit.take(symbols, axis=1)
        emitted /= emitted.max(0)
        n, flow = len(own), np.eye(states, dtype=emit.dtype)[:, :, None] * emitted[:, None, : len(own)]  # to, from, piece
        for t in range(1, len(bounds) - 1):
            low, high = bounds[t], bounds[t + 1]
            if high - low < n:
                out[own[high - low : n]] = flow[:, :, high - low :].transpose(2, 1, 0)
                n = high - low
                flow = flow[:, :, :n].copy()
            flow = (forth @ flow.reshape(states, -1)).reshape(states, states, n)
            flow *= emitted[:, None, low:high]
            if t % 4 == 0:
                flow /= flow.max((0, 1))
        out[own[:n]] = flow.transpose(2, 1, 0)
    return out / out.max((1, 2), keepdims=True)


@dataclass
class Counts:
    """Expected counts of one task."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def zero(classes: int, states: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)).T)  # a state's counts lie together

    def add(self, model: Model, texts: list[np.ndarray], length: int = SEGMENT) -> None:
        """Forward and backward over whole texts (none empty).

        A text of several segments is first reduced to a transfer matrix a segment; their products give the
        states before and behind each segment, with which all segments are walked side by side.
        """
        emit, step = model.emit.astype(np.float32, copy=False), model.step.astype(np.float32)
        states = len(step)
        cut = [segments(x, length) for x in texts]
        pieces = [x for own in cut for x in own]
        heads = np.cumsum([0, *[len(own) for own in cut]])[:-1].astype(np.int64)
        head = np.zeros(len(pieces), bool)
        head[heads] = True
        start, before, end = np.tile(model.first, (len(pieces), 1)), np.zeros((len(pieces), states)), np.ones((len(pieces), states))
        long = [(int(at), len(own)) for at, own in zip(heads, cut) if len(own) > 1]
        emit = np.ascontiguousarray(emit.T)
        flows = iter(transfers(emit, step, [x for at, n in long for x in pieces[at : at + n]]))
        for at, n in long:
            flow = [next(flows) for _ in range(n)]
            for s in range(1, n):
                left = start[at + s - 1] @ flow[s - 1]
                before[at + s] = left / left.sum()
                start[at + s] = before[at + s] @ model.step
            for s in range(n - 2, -1, -1):
                right = model.step @ (flow[s + 1] @ end[at + s + 1])
                end[at + s] = right / right.max()
        room = np.empty((2, 0), np.float32)  # kept over the groups: fresh memory costs as much as the work on it
        for own in groups(pieces):
            symbols, bounds = _by_step([pieces[i] for i in own])
            if room.shape[1] < states * len(symbols):
                room = np.empty((2, states * len(symbols)), np.float32)
            alpha, weigh = room[:, : states * len(symbols)].reshape(2, states, -1)
            self._add(emit, step, symbols, bounds, head[own], start[own].T, before[own].T, end[own].T, alpha, weigh)

    def _add(
        self, emit: np.ndarray, step: np.ndarray, symbols: np.ndarray, bounds: np.ndarray, head: np.ndarray,
        start: np.ndarray, before: np.ndarray, end: np.ndarray, alpha: np.ndarray, weigh: np.ndarray,
    ) -> None:
        """A row a state throughout; ``alpha`` and ``weigh`` are room to work in. ``start``: states at the first token; ``before``: at the token ahead of it (zero: none); ``end``: what follows."""
        running, width = np.diff(bounds), len(head)
        emit.take(symbols, axis=1, out=weigh, mode="clip")  # becomes emission over scale: what a step back multiplies by
        start, forth = start.astype(np.float32), step.T.copy()
        for t, n in enumerate(running):
            low = bounds[t]
            w, a = weigh[:, low : low + n], alpha[:, low : low + n]
            if t == 0:
                np.multiply(start, w, out=a)
            else:
                np.matmul(forth, alpha[:, bounds[t - 1] : bounds[t - 1] + n], out=a)
                a *= w
            scale = 1 / a.sum(0)
            a *= scale
            w *= scale
        lengths = np.searchsorted(-running, -np.arange(width), side="left")  # steps that more sequences reach than lie ahead of it
        last = bounds[lengths - 1] + np.arange(width)
        beta = (end / (alpha[:, last] * end).sum(0)).astype(np.float32)
        alpha[:, last] *= beta  # from here on the share of each state
        moves = np.zeros(step.shape, np.float64)
        for t in range(len(running) - 2, -1, -1):
            n = running[t + 1]
            w, b, a = weigh[:, bounds[t + 1] : bounds[t + 1] + n], beta[:, :n], alpha[:, bounds[t] : bounds[t] + n]
            w *= b
            moves += a @ w.T
            np.matmul(step, w, out=b)
            a *= b
        moves += before @ (weigh[:, :width] * beta).T
        self.step += moves * step
        self.first += alpha[:, :width][:, head].sum(1)
        wide = np.empty(len(symbols))
        for k, shares in enumerate(alpha):
            wide[:] = shares
            self.emit[:, k] += np.bincount(symbols, wide, minlength=len(self.emit))


def improved(counts: Counts, shares: np.ndarray) -> Model:
    """The model that the expected counts give; pseudo-counts keep every class possible."""

    def normal(x: np.ndarray, axis: int) -> np.ndarray:
        return x / x.sum(axis, keepdims=True)

    weight = PRIOR * len(shares)
    return Model(
        normal(counts.first + 1, 0),
        normal(counts.step + 1, 1),
        normal(counts.emit + weight * shares[:, None], 0),
    )


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 to the 24 as three planes of bytes, which pack far better than words of four."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(planes, np.uint8).reshape(3, -1).astype(np.int32)
    return low | mid << 8 | high << 16


def chance(digests: np.ndarray, states: int) -> np.ndarray:
    """Gamma numbers of shape 1/2 and scale 2, the squares of normal ones, drawn by a digest for each state."""

    def even(k: int) -> np.ndarray:
        z = digests + np.uint64((SEED + 1 + k) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((z ^ z >> np.uint64(31)) >> np.uint64(24)).astype(np.float64) / 2.0**40 + 2.0**-41

    normal = [np.sqrt(-2 * np.log(even(2 * k))) * np.cos(2 * np.pi * even(2 * k + 1)) for k in range(states)]
    return np.stack(normal, axis=1) ** 2


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts one after the other, lower case in ASCII, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    each, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(each, "")  # blanks at either end leave empty words
    return each.filter(some).cast(pa.large_binary()), np.bincount(owner.filter(some).to_numpy(), minlength=len(texts))


# --- Spark -----------------------------------------------------------------------------------


def tokenised(docs: DataFrame, parts: int, most: int = BLOCK_BYTES * 3 // 2) -> tuple[DataFrame, DataFrame]:
    """(texts, words) of ``docs`` (id, held_out, text), in one pass.

    texts: (block, id, held_out, n_tokens, local: ``packed`` numbers of the words within the block).
    words: (block, part, words, counts: of the training texts); the numbers of a block's words run through
    its parts in order. A block is as many of a task's Arrow batches as hold ``most`` bytes of text, one at
    least: the fewer blocks, the fewer words stand in several. Texts and words are written at once, so
    that a block's numbers always belong together.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at, size, held, ids, split = 0, 0, [], [], []
        for b in batches:
            here = b.column(2).nbytes
            if split and size + here > most:
                yield from block((task << 24) + at, ids, held, split)
                at, size, held, ids, split = at + 1, 0, [], [], []
            size += here
            held += b.column(1).to_pylist()
            ids.append(b.column(0).cast(pa.int64()))
            split.append(_split(b.column(2)))
        if split:
            yield from block((task << 24) + at, ids, held, split)

    def block(number: int, ids: list[pa.Array], held: list[bool], split: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([n for _, n in split])
        coded = pa.concat_arrays([x for x, _ in split]).dictionary_encode()
        split.clear()
        ids, texts = pa.concat_arrays(ids), np.split(coded.indices.to_numpy(), np.cumsum(lengths)[:-1])
        words = coded.dictionary.to_pylist()
        n, m = len(ids), len(words)
        part = np.fromiter(map(zlib.crc32, words), np.int64, m) % parts
        order = np.argsort(part, kind="stable")
        place = np.empty(m, np.int32)
        place[order] = np.arange(m, dtype=np.int32)
        counts = np.zeros(m, np.int64)
        none = pa.nulls
        lists = pa.list_(pa.binary()), pa.list_(pa.int64())
        names = ["kind", "block", "id", "held_out", "n_tokens", "local", "part", "words", "counts"]
        for low in range(0, n, GROUP):
            some = [place[t] for t in texts[low : min(n, low + GROUP)]]  # without rows there is one empty piece
            k = len(some)
            train = [t for t, h in zip(some, held[low : low + k]) if not h]
            counts += np.bincount(np.concatenate([*train, np.zeros(0, np.int32)]), minlength=m)
            rows = [
                pa.array([0] * k, pa.int32()), pa.array([number] * k, pa.int64()), ids.slice(low, k),
                pa.array(held[low : low + k], pa.bool_()), pa.array([len(t) + 1 for t in some], pa.int64()),
                pa.array([packed(t) for t in some], pa.binary()),
                none(k, pa.int32()), none(k, lists[0]), none(k, lists[1]),
            ]
            yield pa.RecordBatch.from_arrays(rows, names)
        found, starts = np.unique(part[order], return_index=True)
        bounds = pa.array(np.append(starts, m).astype(np.int32))
        k = len(found)
        rows = [
            pa.array([1] * k, pa.int32()), pa.array([number] * k, pa.int64()), none(k, pa.int64()), none(k, pa.bool_()),
            none(k, pa.int64()), none(k, pa.binary()), pa.array(found.astype(np.int32)),
            pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(order)).cast(pa.binary())),
            pa.ListArray.from_arrays(bounds, pa.array(counts)),
        ]
        yield pa.RecordBatch.from_arrays(rows, names)

    schema = (
        "kind int, block bigint, id bigint, held_out boolean, n_tokens bigint, local binary, part int, words array<binary>, counts array<bigint>"
    )
    path = shared_path(spark, "tokens")
    (
        docs.select("id", "held_out", "text").mapInArrow(run, schema)
        .write.partitionBy("kind").option("compression", "zstd").parquet(path)
    )
    reader = spark.read.schema(schema)  # read twice, so that the two frames share no column
    return (
        reader.parquet(path).where("kind = 0").select("block", "id", "held_out", "n_tokens", "local"),
        reader.parquet(path).where("kind = 1").select("block", "part", "words", "counts"),
    )


def counted(words: DataFrame, states: int, classes: int, often: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, own, sums) of the words, each part by a task of its own.

    known: (block, part, c, class, at), packed numbers of a block's words: training count, class (-1: a word
    of its own), and of words of their own the place in their part. own: (part, digest, c) of those
    words. sums: (class, c, v, g0, ...), by part: training tokens, words with any; of words of their own
    (class -1) also (c + 0.5) times what ``chance`` gives and a thousandth.
    """
    spark = words.sparkSession
    g = [f"g{k}" for k in range(states)]
    schema = pa.schema(
        [("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("class", pa.int32()), ("n", pa.int64()), ("v", pa.int64()),
         *[(x, pa.binary()) for x in ("c", "classes", "at", "digest")], *[(x, pa.float64()) for x in g]]
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = rows.sort_by("block")
        coded = pc.list_flatten(rows["words"]).combine_chunks().dictionary_encode()
        codes, found = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        train = pc.list_flatten(rows["counts"]).to_numpy()
        total = np.zeros(len(found), np.int64)
        np.add.at(total, codes, train)
        crc = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
        own = total >= often
        kind = np.where(own, -1, crc % classes).astype(np.int32)
        at = (np.cumsum(own) - 1).astype(np.int32)
        out = []
        bounds = np.append(0, np.cumsum(pc.list_value_length(rows["words"]).to_numpy()))
        for block, a, b in zip(rows["block"].to_pylist(), bounds, bounds[1:]):
            x = codes[a:b]
            few = x[own[x]]
            out.append({"kind": 0, "part": part, "block": block, "c": total[x].tobytes(), "classes": kind[x].tobytes(), "at": at[few].tobytes()})
        seen = np.bincount(kind[~own], total[~own], classes), np.bincount(kind[~own & (total > 0)], minlength=classes)
        out += [{"kind": 1, "class": int(k), "n": int(seen[0][k]), "v": int(seen[1][k])} for k in np.flatnonzero(seen[1])]
        if own.any():
            second = np.array([zlib.crc32(w, SEED) for w, o in zip(found, own) if o], np.uint64)
            digest = crc[own].astype(np.uint64) | second << np.uint64(32)
            c = total[own]
            spread = ((c + 0.5)[:, None] * (chance(digest, states) + 1e-3)).sum(0)
            out.append({"kind": 1, "class": -1, "n": int(c.sum()), "v": len(c), **{x: float(y) for x, y in zip(g, spread)}})
            out.append({"kind": 2, "part": part, "c": c.tobytes(), "digest": digest.tobytes()})
        return pa.Table.from_pylist(out, schema)

    types = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double"}
    ddl = ", ".join(f"{f.name} {types[f.type]}" for f in schema)
    path = shared_path(spark, "words")
    words.groupBy("part").applyInArrow(run, ddl).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    read = lambda kind: spark.read.schema(ddl).parquet(path).where(F.col("kind") == kind)
    return (
        read(0).select("block", "part", "c", F.col("classes").alias("class"), "at"),
        read(2).select("part", "digest", "c"),
        read(1).select("class", F.col("n").alias("c"), "v", *g),
    )


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Packed numbers of several rows as one array."""
    return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(x, dtype) for x in column.to_pylist()]])


def symbols_of(kinds: np.ndarray, end: int) -> np.ndarray:
    """The symbol of each number of a block's words: its class, or a place behind the ``end`` for a word of its own."""
    own = kinds < 0
    return np.where(own, end + np.cumsum(own), kinds).astype(np.int32)


def _by_block(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` written in buckets of blocks, so that rounds read it where it lies; the name and the folder of its table."""
    spark = df.sparkSession
    path = shared_path(spark, "train")
    name = f"train_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "block").sortBy("block").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def fit(
    texts: DataFrame, known: DataFrame, own: DataFrame, shares: np.ndarray, total: float, n_own: int, own_sums: np.ndarray,
    states: int = STATES, rounds: int = ROUNDS,
) -> tuple[Model, np.ndarray, DataFrame]:
    """Baum-Welch over the training texts: each round reads all of them and sums every task's counts.

    ``shares`` are those of the classes and the end, which the driver holds; ``total`` is what
    they are shares of; ``own_sums`` what ``counted`` gives of the words of their own. Those stay in Spark:
    (model, norm, emitted), with emitted (block, part, values) the packed numbers of a block's words of
    their own (float32, a row of states each); divided by ``norm`` they are emissions.
    """
    spark = texts.sparkSession
    n = len(shares)
    end = n - 1
    v = [f"v{k}" for k in range(states)]
    weight = PRIOR * (n + n_own)

    def numbered(key: tuple, texts: pa.Table, rows: pa.Table) -> pa.Table:
        """A block's symbols by how often they stand in its training texts, which keeps what the walk needs most close by; and that order (size 0)."""
        symbol = symbols_of(_joined(rows.sort_by("part")["class"], np.int32), end)
        found, made = [], []
        often = np.zeros(n + int((symbol >= n).sum()), np.int64)
        for low in range(0, texts.num_rows, GROUP):  # texts follow each other in a row, each up to its end
            found.append(np.concatenate([np.append(symbol[unpacked(x)], end) for x in texts["local"].slice(low, GROUP).to_pylist()]))
            often += np.bincount(found[-1], minlength=len(often))
        if found:
            order = np.argsort(-often, kind="stable").astype(np.int32)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order), dtype=np.int32)
            made.append((0, order.tobytes()))
            for x in found:
                planes = packed(rank[x])
                made.append((len(planes), pa.compress(planes, "zstd", asbytes=True)))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(made), pa.int64()),
                "size": pa.array([n for n, _ in made], pa.int64()),
                "symbols": pa.array([x for _, x in made], pa.binary()),
            }
        )

    # A part's rows: what its words are (no block), and where they stand in each block.
    places = own.select("part", F.lit(None).cast("bigint").alias("block"), "digest", "c", F.lit(None).cast("binary").alias("at")).unionByName(
        known.where(F.octet_length("at") > 0).select("part", "block", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("c"), "at")
    )
    messages = "block bigint, part int, values binary"

    def sent(key: tuple, places: pa.Table, counts: pa.Table | None) -> pa.Table:
        if not places.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        lies = places["block"].is_null()
        word = places.filter(lies)
        share = ((_joined(word["c"], np.int64) + 0.5) / total)[:, None]
        blocks = places.filter(pc.invert(lies)).sort_by("block")
        at = [(b, np.frombuffer(x, np.int32)) for b, x in zip(blocks["block"].to_pylist(), blocks["at"].to_pylist())]
        if counts is None:
            values = share * (chance(_joined(word["digest"], np.uint64), states) + 1e-3)
        else:
            values = np.zeros((len(share), states))
            found = dict(zip(counts["block"].to_pylist(), counts["values"].to_pylist()))
            for b, x in at:
                if b in found:
                    values[x] += np.frombuffer(found[b], np.float32).reshape(-1, states)  # a word stands once in a block
            values += weight * share
        values = values.astype(np.float32)
        return pa.table(
            {
                "block": blocks["block"].cast(pa.int64()),
                "part": pa.array([key[0].as_py()] * len(at), pa.int32()),
                "values": pa.array([values[x].tobytes() for _, x in at], pa.binary()),
            }
        )

    def begin(key: tuple, places: pa.Table) -> pa.Table:
        return sent(key, places, None)

    rng = np.random.default_rng(SEED)
    of_classes = shares[:, None] * rng.gamma(0.5, 2.0, (n, states)) + 1e-3 * shares[:, None]
    norm = of_classes.sum(0) + own_sums / total
    model = Model.initial(shares, states)
    model = Model(model.first, model.step, of_classes / norm)
    emitted = places.groupBy("part").applyInArrow(begin, messages)
    schema = "block bigint, part int, values binary, number int, " + ", ".join(f"{x} double" for x in v)

    def expect(key: tuple, texts: pa.Table, sent: pa.Table) -> pa.Table:
        sent = sent.sort_by("part")
        emit = _joined(sent["values"], np.float32).reshape(-1, states) / norm
        emit = np.concatenate([model.emit, emit]).astype(np.float32)
        counts = Counts.zero(len(emit), states)
        if texts.num_rows:
            rows = list(zip(texts["size"].to_pylist(), texts["symbols"].to_pylist()))
            order = next(np.frombuffer(x, np.int32) for size, x in rows if not size)
            stop = np.flatnonzero(order == end)[0]
            found = [unpacked(pa.decompress(x, size, "zstd")) for size, x in rows if size]
            counts.add(Model(model.first, model.step, emit[order]), [t for x in found for t in np.split(x, np.flatnonzero(x == stop) + 1)[:-1]])
            for k in range(states):
                counts.emit[order, k] = counts.emit[:, k].copy()
        shared = np.concatenate([counts.emit[:n], counts.first[None], counts.step, counts.emit[n:].sum(0)[None]])
        found = counts.emit[n:].astype(np.float32)
        bounds = np.append(0, np.cumsum([len(x) for x in sent["values"].to_pylist()])).astype(np.int64) // (4 * states)
        few, rows = len(shared), sent.num_rows
        part = pa.concat_arrays([pa.nulls(few, pa.int32()), *sent["part"].cast(pa.int32()).chunks])
        packs = pa.concat_arrays([pa.nulls(few, pa.binary()), pa.array([found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())])
        number = pa.concat_arrays([pa.array(np.arange(few, dtype=np.int32)), pa.nulls(rows, pa.int32())])
        columns = [pa.concat_arrays([pa.array(shared[:, k]), pa.nulls(rows, pa.float64())]) for k in range(states)]
        return pa.table([pa.array(np.full(few + rows, key[0].as_py())), part, packs, number, *columns], names=["block", "part", "values", "number", *v])

    train, name, folder = _by_block(
        texts.where(~F.col("held_out")).select("block", "local").groupBy("block")
        .cogroup(known.select("block", "part", "class").groupBy("block")).applyInArrow(numbered, "block bigint, size bigint, symbols binary")
    )
    path = None
    try:
        for _ in range(rounds):
            path, before = shared_path(spark, "round"), path
            train.groupBy("block").cogroup(emitted.groupBy("block")).applyInArrow(expect, schema).write.option("compression", "zstd").parquet(path)
            out = spark.read.schema(schema).parquet(path)
            if before:
                delete(spark, before)  # the round before is summed up in this one
            # Bounded by what the driver holds of the model: classes + states + 3 rows.
            sums = out.where("number is not null").groupBy("number").agg(*[F.sum(x).alias(x) for x in v]).toPandas()
            rows = np.zeros((n + states + 2, states))
            rows[sums["number"].to_numpy(np.int64)] = sums[v].to_numpy()
            emit, first, step = rows[:n], rows[n], rows[n + 1 : n + 1 + states]
            new = emit + weight * shares[:, None]
            norm = new.sum(0) + rows[-1] + weight * (1 - shares.sum())
            model = improved(Counts(first, step, emit), shares)
            model = Model(model.first, model.step, new / norm)
            counts = out.where("values is not null").select("part", "block", "values")
            emitted = places.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(sent, messages)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, folder)
    return model, norm, emitted


def score_texts(
    docs: DataFrame, id_: str, text: str, held_out: Column, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, often: int = OFTEN
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    The model learns from the rows where ``held_out`` is not true. Scores are log10 probabilities of
    the whole text and its end: ``base_score`` of the unigram counts alone, ``score`` of the hidden
    Markov model. Words that stand ``often`` times in the training rows are emitted by themselves,
    others by their class. Null and empty texts are just an end; null ids stay null. Repeated rows
    count as often as they stand. Without training rows nothing is known, and all probability rests
    on what was never seen. ``id`` must be a whole number. Only the two columns named are read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(quoted(id_)).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(quoted(text)).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with swept_shuffles(spark):
        # Two blocks a core, more beyond BLOCK_BYTES each: every block sends and gets the numbers of all its words in each round.
        blocks = max(2 * spark.sparkContext.defaultParallelism, size // BLOCK_BYTES)
        texts, words = tokenised(rows.coalesce(blocks), max(PARTS, size // PART_BYTES))
        known, own, sums = counted(words, states, classes, often)
        g = [f"g{k}" for k in range(states)]
        heads = sums.groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v"), *[F.sum(x).alias(x) for x in g])
        by_class = {r["class"]: r for r in heads.collect()}  # a row per class and one for the words of their own
        none = {"c": 0, "v": 0, **dict.fromkeys(g, 0.0)}
        of_own = by_class.get(-1, none)
        own_size, n_own = of_own["c"], of_own["v"]
        ends = texts.where(~F.col("held_out")).count()
        size = np.array([by_class.get(k, none)["c"] for k in range(classes)] + [ends], np.float64)
        kinds = np.array([by_class.get(k, none)["v"] for k in range(classes)] + [int(ends > 0)], np.float64)
        n, v = int(size.sum()) + own_size, int(kinds.sum()) + n_own
        total = n + 0.5 * (len(size) + n_own)
        own_sums = np.array([of_own[x] for x in g], np.float64)
        model, norm, emitted = fit(texts, known, own, (size + 0.5) / total, total, n_own, own_sums, states, rounds)
    floor = np.log10(n + 0.5 * (v + 1))
    within = np.log10(size + 0.5 * (kinds + 1))
    known_end = int(ends > 0)
    end_base = np.log10(ends + 0.5) - floor

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        kind = _joined(found["class"].drop_null(), np.int32)
        symbol, own = symbols_of(kind, classes), kind < 0
        emit = _joined(found["values"].drop_null(), np.float32).reshape(-1, states) / norm
        whole = Model(model.first, model.step, np.concatenate([model.emit, emit]))
        c = _joined(found["c"].drop_null(), np.int64)
        logs = np.log10(c + 0.5)
        # What the class leaves open; nothing for a word of its own, and for the end, the only one of its class.
        spread = np.where(own, 0.0, logs - within[np.where(own, 0, kind)])
        base, score, known = [], [], []
        for low in range(0, texts.num_rows, 2 * GROUP):
            local = [unpacked(x) for x in texts["local"].slice(low, 2 * GROUP).to_pylist()]
            hmm = log10_likelihoods(whole, [np.append(symbol[x], classes) for x in local])
            score += (hmm + np.array([spread[x].sum() for x in local])).tolist()
            base += [logs[x].sum() - len(x) * floor + end_base for x in local]
            known += [int((c[x] > 0).sum()) + known_end for x in local]
        return pa.table(
            {
                "id": texts["id"],
                "held_out": texts["held_out"],
                "n_tokens": texts["n_tokens"],
                "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    result = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    blank = lambda x: F.lit(None).cast("binary").alias(x)
    words = known.select("block", "part", "c", "class", blank("values")).unionByName(
        emitted.select("block", "part", blank("c"), blank("class"), "values")
    )
    scored = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(score, result)
    return scored.select(
        F.col("id").alias(id_), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score_texts(docs, "doc_id", "text", held_out)
