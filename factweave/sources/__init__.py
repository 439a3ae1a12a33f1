"""Readers and writers of raw facts."""
