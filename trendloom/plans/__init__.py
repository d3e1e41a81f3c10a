"""Plans: the registered queries over the test tables."""

from . import layers, models, queries, report, texts  # noqa: F401
