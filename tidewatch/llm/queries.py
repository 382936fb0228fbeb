"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import chat, chosenpath, compaction, curriculum, langid, latent, prefixtrie, pseudonyms, sstable, tokencount, topk, toxicity, whitening

QUERIES = {
    "op1_sstable_tokens": sstable.op1_sstable_tokens,
    "op2_latent_decontamination": latent.op2_latent_decontamination,
    "op3_convolutional_toxicity": toxicity.op3_convolutional_toxicity,
    "op4_size_tiered_compaction": compaction.op4_size_tiered_compaction,
    "op5_chosen_path_join": chosenpath.op5_chosen_path_join,
    "op6_string_kernel_language": langid.op6_string_kernel_language,
    "op7_curriculum_mix": curriculum.op7_curriculum_mix,
    "op8_uniform_threshold_topk": topk.op8_uniform_threshold_topk,
    "op9_grammar_round_trip": chat.op9_grammar_round_trip,
    "op10_feistel_pseudonyms": pseudonyms.op10_feistel_pseudonyms,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_lobpcg_whitening": whitening.op12_lobpcg_whitening,
    "op13_rank_synchronous_counts": tokencount.op13_rank_synchronous_counts,
}

ORACLES: dict[str, str] = {"op4_size_tiered_compaction": compaction.OP4_SQL, "op7_curriculum_mix": curriculum.OP7_SQL, "op8_uniform_threshold_topk": topk.OP8_SQL, "op9_grammar_round_trip": chat.OP9_SQL, "op11_prefix_trie": prefixtrie.OP11_SQL}
