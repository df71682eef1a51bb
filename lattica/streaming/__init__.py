"""Graphs that grow while they are queried."""
