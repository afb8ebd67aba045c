"""Readers, sinks and the shared folder they use."""
