"""Readers, sinks and the domain views."""
