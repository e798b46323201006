"""All registered queries of the document operators, with their SQL."""

from __future__ import annotations

from docstrata.plans import catalogue, documents, edited, glyphs, pages, painted, placed, shifted  # noqa: F401  (registers its queries)

QUERIES = catalogue.QUERIES | documents.QUERIES | placed.QUERIES | edited.QUERIES | painted.QUERIES
ORACLES = catalogue.ORACLES | documents.ORACLES | placed.ORACLES
