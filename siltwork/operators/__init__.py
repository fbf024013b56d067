"""Relational, windowed and greedy operators."""
