"""The queries of the operators of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tidelog.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, license_scan, lm_scoring, minhash_dedup, packing, quality, token_files


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_language_id": language_id.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_minhash_dedup": minhash_dedup.query,
    "op7_packing": packing.query,
    "op8_token_files": token_files.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_quality": quality.query,
    "pipeline": pipeline,
}

ORACLE = {"op4_exact_dedup": exact_dedup.SQL}
