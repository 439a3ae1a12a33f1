"""Snapshots as a stream."""
