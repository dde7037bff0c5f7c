"""Readers, source checks, fingerprints and result writers."""
