"""Column functions: text, formulas, tables, protection, Markdown."""
