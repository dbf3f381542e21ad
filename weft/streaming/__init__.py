"""Streams of graph changes."""
