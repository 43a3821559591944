"""The queries of this subpackage and, where SQL can express them, their SQL."""

from foliant.llm import op1_sharding, op2_tokens, op3_mixing, op4_quality, op5_language, op6_jaccard, op7_toxicity, op8_urls, op9_decontamination, op10_templates, op11_infill, op12_codes, op13_warc, oracles

QUERIES = {
    "op1_hilbert_shards": op1_sharding.query,
    "op2_trie_tokens": op2_tokens.query,
    "op3_sainte_lague_mix": op3_mixing.query,
    "op4_line_frequency": op4_quality.query,
    "op5_language_bitmasks": op5_language.query,
    "op6_partenum_join": op6_jaccard.query,
    "op7_toxicity_trees": op7_toxicity.query,
    "op8_url_models": op8_urls.query,
    "op9_positional_index": op9_decontamination.query,
    "op10_line_templates": op10_templates.query,
    "op11_chunked_infill": op11_infill.query,
    "op12_elkan_codes": op12_codes.query,
    "op13_warc_members": op13_warc.query,
}

ORACLE: dict[str, str] = {
    "op4_line_frequency": oracles.LINE_FREQUENCY,
    "op6_partenum_join": oracles.PARTENUM_JOIN,
    "op9_positional_index": oracles.POSITIONAL_INDEX,
    "op10_line_templates": oracles.LINE_TEMPLATES,
    "op11_chunked_infill": oracles.INFILL,
    "op12_elkan_codes": oracles.VECTOR_CODES,
    "op13_warc_members": oracles.WARC_MEMBERS,
}
