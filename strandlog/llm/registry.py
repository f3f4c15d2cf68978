"""The queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import audio, bpe, language_mix, language_model, line_crf, mixing, quality_rules, secret_scan, simhash, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_store.op1_token_store,
        mixing.op2_mix_sources,
        audio.op3_audio_features,
        quality_rules.op4_quality_divergence,
        language_model.op5_deleted_interpolation,
        line_crf.op6_line_quality,
        language_mix.op7_language_mixture,
        secret_scan.op8_secret_scan,
        simhash.op9_simhash_ball,
        bpe.op10_bpe_codec,
    )
}

ORACLE_SQL = {"op2_mix_sources": mixing.OP2_SQL, "op4_quality_divergence": quality_rules.OP4_SQL}
