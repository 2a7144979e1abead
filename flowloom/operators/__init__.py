"""Relational, window and graph operators over flow tables."""
