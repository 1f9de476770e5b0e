"""Queries of the training-data operators and the SQL of those that SQL can express."""

from . import ann, langid, minhash, mixing, negatives, packing, sharding, spelling, spotsigs, suffixes, tiles, url_filters, warc

QUERIES = {
    "op1_kmeans_tree_search": ann.op1_kmeans_tree_search,
    "op2_temperature_mixing": mixing.op2_temperature_mixing,
    "op3_hilbert_shards": sharding.op3_hilbert_shards,
    "op4_minmax_near_duplicates": minhash.op4_minmax_near_duplicates,
    "op5_language_evidence": langid.op5_language_evidence,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_url_list_asof": url_filters.op9_url_list_asof,
    "op10_spotsigs": spotsigs.op10_spotsigs,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_int8_near_vectors": tiles.op12_int8_near_vectors,
    "op13_bit_sliced_negatives": negatives.op13_bit_sliced_negatives,
    "warc_salvage": warc.warc_salvage,
    "spotsigs_near_duplicates": spotsigs.spotsigs_near_duplicates,
}
ORACLE_SQL = {
    "op4_minmax_near_duplicates": minhash.OP4_SQL,
    "op8_warc_round_trip": warc.OP8_SQL,
    "op9_url_list_asof": url_filters.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_int8_near_vectors": tiles.OP12_SQL,
    "op13_bit_sliced_negatives": negatives.OP13_SQL,
    "warc_salvage": warc.SALVAGE_SQL,
}
