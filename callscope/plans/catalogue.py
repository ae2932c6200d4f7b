"""The query catalogue: every operator run over the stand-in views.

Importing this module registers all queries in ``registry.QUERIES`` and their
oracle SQL in ``registry.ORACLE``.
"""

from callscope.plans import q_eval, q_sequence, q_labels, q_resample, q_text, q_tokens, q_ml, q_closing, q_stream  # noqa: F401
from callscope.plans.registry import ORACLE, QUERIES  # noqa: F401
