"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import q_ancestry, q_audits, q_contrasts, q_evaluation, q_graph, q_intervals, q_models, q_pairs, q_scores, q_stats, q_streams, q_variants

MODULES = (q_variants, q_intervals, q_pairs, q_graph, q_stats, q_streams, q_ancestry, q_models, q_evaluation, q_contrasts, q_scores, q_audits)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
