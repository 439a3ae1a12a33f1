"""Relational and graph operators over fact tables."""
