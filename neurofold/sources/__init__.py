"""Readers and writers of the raw formats."""
