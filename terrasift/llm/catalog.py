"""The subpackage's registered queries: name -> (callable, DuckDB text or None)."""

from terrasift.llm import audit, decontam, extract, jaccard, minhash, periods, pieces, quality, tokencount, topk, toxicity, urls, warc

QUERIES = {
    "op1_exact_top_k": (topk.query, topk.SQL),
    "op2_benchmark_decontamination": (decontam.query, decontam.SQL),
    "op3_warc": (warc.query, warc.SQL),
    "op4_quality_classifier": (quality.query, None),
    "op5_sentencepiece": (pieces.query, None),
    "op6_token_counts": (tokencount.query, None),
    "op7_minhash_near_duplicates": (minhash.query, minhash.SQL),
    "op8_url_filters": (urls.query, urls.SQL),
    "op9_html_extraction": (extract.query, None),
    "op10_toxicity": (toxicity.query, None),
    "op11_filter_interaction_audit": (audit.query, audit.SQL),
    "op12_ngram_jaccard_join": (jaccard.query, jaccard.SQL),
    "op13_periodic_runs": (periods.query, periods.SQL),
}
