"""Helpers that shape physical plans: sessions and lineage cuts."""
