"""The library's operators as named queries on the given tables, each with its SQL twin."""
