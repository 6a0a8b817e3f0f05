"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, lm_score, odd_sketch, periodic_runs, quality, secrets, sentencepiece_model, simhash, spelling_variants, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_model.op1_sentencepiece,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_secrets": secrets.op5_secrets,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_minhash": odd_sketch.op13_minhash,
}
ORACLES = {
    "op2_lm_score": lm_score.SQL,
    "op5_secrets": secrets.SQL,
    "op7_warc": warc.SQL,
    "op8_url_filter": url_filter.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
