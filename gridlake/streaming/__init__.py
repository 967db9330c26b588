"""Time-dependent operators: hot keys and expiry (T3, T4), ticks and sessions (T5, T6),
continuous cell updates (T1, T2), in batch and Structured Streaming forms."""
