"""Registered queries.  Importing this package fills ``registry.QUERIES`` / ``ORACLE``."""

from tillsight.plans import q_audits, q_evaluate, q_features, q_rules, q_encode, q_mining, q_models, q_sampling, q_sources, q_stats  # noqa: F401
from tillsight.plans.registry import ORACLE, QUERIES  # noqa: F401
