"""Tick sources and table writers."""
