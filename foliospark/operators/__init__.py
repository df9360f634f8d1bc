"""Operators on content items, formulas, translation work, rendering and tasks; all on DataFrames keyed by document."""
