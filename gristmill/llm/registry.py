"""The queries of this subpackage and their SQL."""

from gristmill.llm import embeddings, fingerprints, lines, lm, mixing, neardup, packing, pii, quality, search, secrets, sharding, spelling

QUERIES = {
    "op1_subspace_pigeonhole_join": embeddings.vectors_deduplicated,
    "op2_weak_supervision_pii": pii.documents_searched,
    "op3_site_line_dedup": lines.pages_without_boilerplate,
    "op4_threshold_fingerprints": fingerprints.documents_fingerprinted,
    "op5_structural_secrets": secrets.documents_scanned,
    "op6_hierarchical_quality": quality.documents_classified,
    "op7_sampled_splitters": sharding.documents_sharded,
    "op8_minhash_lsh_forest": neardup.documents_deduplicated,
    "op9_entropy_balancing": mixing.documents_mixed,
    "op10_cost_balanced_packing": packing.documents_packed,
    "op11_letter_parity_bands": spelling.documents_spelled,
    "op12_log_bilinear_scores": lm.documents_scored,
    "op13_two_level_search": search.items_ranked,
}
SQL: dict[str, str] = {
    "op1_subspace_pigeonhole_join": embeddings.SQL,
    "op3_site_line_dedup": lines.SQL,
    "op8_minhash_lsh_forest": neardup.SQL,
    "op11_letter_parity_bands": spelling.SQL,
    "op12_log_bilinear_scores": lm.documents_scored,
    "op13_two_level_search": search.SQL,
}
