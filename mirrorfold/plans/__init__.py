"""Catalog state transitions, expressed as snapshot -> snapshot plans."""
