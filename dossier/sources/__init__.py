"""Readers, file extraction, sinks and materialized stages."""
