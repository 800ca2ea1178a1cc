"""All registered queries, in inventory order."""

from __future__ import annotations

from maskloom.plans import q_clean, q_metrics, q_profile, q_rules, q_scores, q_sources, q_spans, q_synth, q_tokens
from maskloom.plans.detect import flagship
from maskloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
_ = (q_sources, q_tokens, q_scores, q_rules, q_spans, q_metrics, q_clean, q_synth, q_profile)
