"""Readers and writers for the record shapes the engine consumes and produces."""
