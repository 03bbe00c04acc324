"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from neurospan.llm import exact_dedup, jaccard_join, kneser_ney, mixing, packing, periodic_runs, pii, quality_rules, repeats, secrets, token_counts, turn_repair, url_rules


def queries():
    return {
        "op1_weak_supervision": pii.op1_weak_supervision,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_kneser_ney": kneser_ney.op4_kneser_ney,
        "op5_pareto_mix": mixing.op5_pareto_mix,
        "op6_best_fit": packing.op6_best_fit,
        "op7_deep_shallow": repeats.op7_deep_shallow,
        "op8_url_rules": url_rules.op8_url_rules,
        "op9_secret_ownership": secrets.op9_secret_ownership,
        "op10_host_rules": quality_rules.op10_host_rules,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_lyndon_runs": periodic_runs.op12_lyndon_runs,
        "op13_turn_repair": turn_repair.op13_turn_repair,
    }


def oracle_sql():
    return {
        "op3_exact_dedup": exact_dedup.SQL,
        "op5_pareto_mix": mixing.SQL,
        "op9_secret_ownership": secrets.SQL,
        "op10_host_rules": quality_rules.SQL,
        "op13_turn_repair": turn_repair.SQL,
    }
