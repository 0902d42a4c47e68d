"""Incremental matching of arriving documents."""
