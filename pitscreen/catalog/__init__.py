"""All registered queries and their SQL counterparts."""
from .base import ORACLES, QUERIES  # noqa: F401
from . import indicators  # noqa: F401
from . import inputs, jobs, outcomes, reports, streams  # noqa: F401
