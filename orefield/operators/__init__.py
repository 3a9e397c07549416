"""Relational and graph operators over the node, edge, unit and history tables."""
