"""Queries that combine the operators over the driver's tables; importing this package registers them."""

from shelfwise.plans import basics, channels, decisions, families, files, forms, regions, relations, scores, splits, storage, texts  # noqa: F401
