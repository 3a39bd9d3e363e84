"""Operators for preparing text corpora; self-contained on top of ``factweave.session``."""
