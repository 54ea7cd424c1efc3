from . import guards, scalars, stats, tiers  # noqa: F401
