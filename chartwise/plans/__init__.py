"""Query catalogue: every implemented operator as a registered query."""

from chartwise.plans import q_encode, q_ingest, q_learn, q_models, q_stream, q_prepare, q_profile, q_rates, q_stats, q_trends  # noqa: F401
from chartwise.plans import q_reports  # noqa: F401  (after the analyses that it reports)
from chartwise.plans.registry import HEADLINE, ORACLES, QUERIES  # noqa: F401
