"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, html, infill, licenses, minhash, mixing, quality, resample, sequences, toxicity, vector_dedup


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_html": html.op2_html,
        "op3_ann": ann.op3_ann,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_bpe": bpe.op5_bpe,
        "op6_quality": quality.op6_quality,
        "op7_sequences": sequences.op7_sequences,
        "op8_mixing": mixing.op8_mixing,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_minhash": minhash.op10_minhash,
        "op11_vector_dedup": vector_dedup.op11_vector_dedup,
        "op12_infill": infill.op12_infill,
        "op13_resample": resample.op13_resample,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op9_license_scan": licenses.SQL, "op12_infill": infill.SQL, "op13_resample": resample.SQL}
