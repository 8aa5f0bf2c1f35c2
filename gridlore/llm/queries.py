"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from gridlore.llm import ann, bpe, cover, dialogue, jaccard, minhash, mixing, parsing, pii, ranked, topk, toxicity, urlfilter

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_ann_multi_index": ann.op3_ann_multi_index,
    "op4_suffix_dedup": parsing.op4_suffix_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_cover_dedup": cover.op8_cover_dedup,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": dialogue.op11_conversation_repair,
    "op12_minhash_dedup": minhash.op12_minhash_dedup,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLES = {
    "op1_exact_topk": topk.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_suffix_dedup": parsing.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op8_cover_dedup": cover.ORACLE,
    "op11_conversation_repair": dialogue.ORACLE,
    "op12_minhash_dedup": minhash.ORACLE,
    "op13_ranked_search": ranked.ORACLE,
}
