"""Operators for preparing text corpora: screening, scoring, counting, storing, comparing and encoding documents."""
