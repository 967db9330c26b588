"""Scalar Column functions (F-ids of the survey); all run inside whole-stage codegen."""
