"""Composed plans: the analysis chain, its plot catalogue, the fixture event model and the registered queries."""
