"""Readers, writers and flow views."""
