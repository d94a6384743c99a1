"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairflow.llm import ann, language, lm, mixing, phrases, pieces, quality, secrets, simhash, tokens, tools, warc, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        tokens.op1_token_counts,
        secrets.op2_secrets,
        warc.op3_warc,
        ann.op4_neighbours,
        tools.op5_tool_calls,
        simhash.op6_simhash,
        quality.op7_quality_rules,
        quality.quality_ablations,
        mixing.op8_mixing,
        lm.op9_lm_scores,
        pieces.op10_sentencepiece,
        phrases.op11_phrases,
        language.op12_languages,
        whiten.op13_whitening,
    )
}

ORACLE = {
    "op3_warc": warc.OP3_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_phrases": phrases.OP11_SQL,
}
