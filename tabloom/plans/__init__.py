"""Compositions of operators: preparation chain, search, race."""
