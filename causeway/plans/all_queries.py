"""Every registered query of the library."""

from . import q_aggregates, q_models, q_relational, q_sources, q_streaming, q_text, q_windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
