"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry again and again. The automaton is a trie with a
failure link per node: where the next character does not go on, the link tells which node the rest
of the match leads to, and a number stored with it how many tokens were completed on the way. A word
is read once, left to right, without going back and without building its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 400_000
"""Words whose counts a task remembers; only a matter of speed."""


class Automaton:
    """Counts the greedy pieces of words: ``initial`` may begin a word, ``inner`` may go on with one."""

    def __init__(self, initial: list[str], inner: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 goes on with it
        final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    found = self.next[node].get(c)
                    if found is None:
                        found = len(self.next)
                        self.next[node][c] = found
                        self.next.append({})
                        final.append(False)
                    node = found
                if piece:
                    final[node] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [(0, -1, ""), (1, -1, "")]
        while level:
            below = []
            for node, parent, c in level:
                if parent >= 0:
                    if final[node]:
                        self.fail[node], self.popped[node] = 1, 1
                    else:
                        at, popped = self.fail[parent], self.popped[parent]
                        while at >= 0 and c not in self.next[at]:
                            popped += self.popped[at]
                            at = self.fail[at]
                        if at >= 0:
                            self.fail[node], self.popped[node] = self.next[at][c], popped
                below += [(child, node, x) for x, child in self.next[node].items()]
            level = below

    def count(self, word: str) -> int:
        """Pieces of ``word``; -1 where greedy matching cannot go on, so that the word is unknown."""
        next_, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            while (to := next_[node].get(c)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def piece_vocabulary(path: str = MODEL) -> tuple[list[str], list[str]]:
    """(initial, inner) word pieces of a SentencePiece file: those with a leading space mark begin words."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [
        p.id_to_piece(i)
        for i in range(p.get_piece_size())
        if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))
    ]
    return (
        [x[1:] for x in normal if x[0] == "▁" and len(x) > 1 and "▁" not in x[1:]],
        [x for x in normal if "▁" not in x],
    )


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    vocabulary: tuple[list[str], list[str]] | None = None,
    into: tuple[str, str, str] = ("n_words", "n_tokens", "n_unknown"),
) -> DataFrame:
    """Each row of ``docs`` with its words, their tokens, and how many words are unknown (bigint each).

    Words are parted by the six ASCII spaces, as in the rest of the subpackage. A word that cannot be
    cut into pieces is one unknown token. Null and empty texts have none of either. Repeated rows
    are counted each for itself. Columns of ``docs`` named like the results are replaced.
    """
    initial, inner = vocabulary or piece_vocabulary()
    taken = {x.lower() for x in into}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.LongType()) for x in into]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(initial, inner))
        for b in batches:
            found = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                each = [counts[w] for w in t.encode("utf-8", "replace").split()] if t else []
                unknown = each.count(-1)
                found.append((len(each), sum(each) + 2 * unknown, unknown))
            made = [pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *into])

    return docs.mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of words, tokens and unknown words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_words", "n_tokens", "n_unknown")
