"""Operators on panels, scores, portfolios, graphs, texts and keyed tables."""
