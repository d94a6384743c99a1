from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.llm import pieces, tokens

V = pieces.load()
ODD = [None, "", " ", "  a  b ", "Hello world,\n\nthe token", "你好 é\U0001F600 \x00\x7f", "=" * 500, "abc" * 400, "the " * 900, "a▁b"]


def score_of(ids, text):
    """Score of a segmentation, unknown characters counted once each."""
    total, run = 0, b""
    for i in ids:
        if i in V.byte_ids:
            run += bytes([V.byte_ids.index(i)])
        else:
            total += V.scores[i]
    return total + V.unknown * len(run.decode())


def test_segmentation_is_the_best_one():
    for text in ODD:
        s = pieces.marked(text or "")
        best = [0] + [None] * len(s)
        known = {p: x for p, x in zip(V.pieces, V.scores) if p}
        for j in range(1, len(s) + 1):
            best[j] = max(
                [best[j - 1] + V.unknown] + [best[i] + known[s[i:j]] for i in range(max(0, j - V.longest), j) if s[i:j] in known]
            )
        score, ids = pieces.encode_part(V, s)
        assert score == best[-1] == score_of(np.frombuffer(ids, np.int32).tolist(), s)


def test_library_finds_the_same_scores():
    """SentencePiece's own unigram search over the same pieces and scores."""
    sp = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p, score in zip(proto.pieces, V.scores):
        p.score = score / pieces.UNIT
    other = sp.SentencePieceProcessor()
    other.LoadFromSerializedProto(proto.SerializeToString())
    for text in ODD[3:8]:
        text = text[:60]
        ours = pieces.encode_part(V, pieces.marked(text))[0]
        assert score_of(other.encode(text), text) == pytest.approx(ours, abs=50)


def in_chunks(s, length):
    """Score and ids of a text by chunks, without Spark."""
    parts = [(s[i : i + length + V.reach - 1], min(length, len(s) - i)) for i in range(0, len(s), length)]
    after, total = pieces.scores_after(np.stack([pieces.transfer(V, p, n) for p, n in parts]))
    exits = []
    for (p, n), scores in zip(parts, after):
        at, passed = pieces.loose_end(V, p, n)
        exits.append(pieces.exit_states(V, p[at:], n - at, scores, passed))
    states = pieces.followed(exits)
    assert states[-1][1] == 0
    return total, b"".join(pieces.encode_part(V, p[a : n + b])[1] for (p, n), (a, b) in zip(parts, states))


def test_chunks_give_the_same_as_one_pass():
    rng = random.Random(3)
    bits = ["the ", "ion", "\n", "  ", "é", "你", "x", "token", "====", "▁", "a"]
    for k in range(120):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) if k % 3 else "abcdefghijkl" * rng.randint(1, 15)
        s, length = pieces.marked(text), rng.choice([16, 20, 37])
        total, ids = in_chunks(s, length)
        assert (total, ids) == pieces.encode_part(V, s)
        assert pieces.decode_ids(V, np.frombuffer(ids, np.int32)) == text.replace("▁", " ")


def test_ties_do_not_depend_on_the_chunk():
    """Runs of one character have many equally good segmentations."""
    for text in ("-" * 333, " " * 300, "=" * 257, "a" * 211, "ab" * 150, " " * 90 + "-" * 90 + "\n" * 90, "." * 64 + "é" * 70):
        s = pieces.marked(text)
        for length in (16, 17, 31, 50, 100, 128, 1000):
            assert in_chunks(s, length) == pieces.encode_part(V, s), (text[:5], length)


def test_ids_of_rows_do_not_depend_on_the_chunk(docs):
    rows = docs([*ODD, "-" * 333, " " * 300, "x" * 700 + "\n" * 200])
    of = lambda chunk: sorted((r["doc_id"], r["ids"], r["score"]) for r in pieces.encode(rows, vocabulary=V, chunk=chunk).collect())
    assert of(100) == of(23) == of(pieces.CHUNK)


def test_product_is_associative():
    rng = np.random.default_rng(1)
    m = rng.integers(-1000, 0, (9, 4, 4))
    m[rng.random(m.shape) < 0.2] = pieces.LOST
    step = m[0]
    for x in m[1:]:
        step = pieces.product(step, x)
    assert (pieces.scan(m)[-1] == step).all()


def test_round_trip_of_rows_short_and_long(spark, docs, documents):
    frame = docs(ODD * 2).withColumn("ids", F.lit("mine")).withColumn("_sha", F.lit(1))
    for rows, chunk in ((frame, 64), (documents, 4096)):
        back = pieces.decode(pieces.encode(rows, vocabulary=V, chunk=chunk), vocabulary=V).collect()
        assert len(back) == rows.count()
        for r in back:
            text = r["text"] or ""
            assert r["decoded"] == text.replace("▁", " ")
            assert r["score"] == pieces.encode_part(V, pieces.marked(text))[0]
    assert pieces.encode(docs(["x"]).where("false"), vocabulary=V).count() == 0


def test_last_stage(spark, docs):
    out = pieces.tokenise(spark, docs(ODD), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_pieces", "restored"]
    assert all(r["restored"] and r["n_pieces"] == len(r["ids"]) for r in out.collect())


# --- token counts ----------------------------------------------------------------------------


def greedy(word, initial, inner):
    n, at = 0, 0
    while at < len(word):
        known = inner if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_counts_equal_greedy_matching(documents):
    initial, inner = tokens.piece_vocabulary()
    a, b, auto = set(initial), set(inner), tokens.Automaton(initial, inner)
    words = {w for r in documents.limit(60).collect() for w in r["text"].split()} | {"é" * 40, "你好", "##", "a" * 3000, "$$$", "x\x1f"}
    for w in words:
        assert auto.count(w) == greedy(w, a, b), w


def test_small_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        pick = lambda: ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]
        initial, inner = pick(), pick()
        auto = tokens.Automaton(initial, inner)
        for _ in range(20):
            w = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
            assert auto.count(w) == greedy(w, set(initial), set(inner)), (initial, inner, w)


def test_counts_of_rows(docs):
    vocabulary = (["a", "ab"], ["b", "c"])
    frame = docs([None, "", "ab abc x", "a\n b", "abbb " * 3000, "ab abc x"]).withColumn("n_tokens", F.lit("mine"))
    got = tokens.count_tokens(frame, vocabulary=vocabulary).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_tokens"], r["n_unknown"]) for r in got] == [
        (0, 0, 0), (0, 0, 0), (3, 4, 1), (2, 2, 1), (3000, 9000, 0), (3, 4, 1),
    ]
    assert tokens.count_tokens(frame.where("false"), vocabulary=vocabulary).count() == 0
