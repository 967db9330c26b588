"""Sinks: JSON event exports and budgeted exports (K1-K4, K6)."""
