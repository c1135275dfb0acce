"""Readers, sinks and the seams to what lies outside the engine (model calls, fetching)."""
