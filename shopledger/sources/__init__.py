"""Readers, header checks and sinks."""
