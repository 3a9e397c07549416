"""Readers: table folders, source trees, the append-only store."""
