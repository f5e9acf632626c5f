"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from costgrain.llm import brown, conversations, covertree, language, licences, minhash, mixing, packing, periodicity, quality, resharding, simhash, toxicity

QUERIES = {
    "op1_length_buckets": packing.op1,
    "op2_dual_cover_tree": covertree.op2,
    "op3_min_cost_resharding": resharding.op3,
    "op4_block_mixing": mixing.op4,
    "op5_bradley_terry_quality": quality.op5,
    "op6_rare_token_licences": licences.op6,
    "op7_noisy_channel_toxicity": toxicity.op7,
    "op8_brown_classes": brown.op8,
    "op9_simhash": simhash.op9,
    "op10_one_permutation_minhash": minhash.op10,
    "op11_periodic_runs": periodicity.op11,
    "op12_conversation_repair": conversations.op12,
    "op13_error_correcting_language": language.op13,
}

ORACLES: dict[str, str] = {"op2_dual_cover_tree": covertree.ORACLE}
