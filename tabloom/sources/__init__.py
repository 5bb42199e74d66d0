"""Readers and writers for kits, trial tables and predictions."""
