"""Imports every query module so their queries register."""

from convlake.plans import q_history, q_logs, q_provider, q_requests, q_rules, q_sequential, q_text  # noqa: F401
from convlake.plans import q_chat, q_io, q_streams  # noqa: F401,E402  (reuse oracles registered above)
from convlake.plans.registry import REGISTRY  # noqa: F401
