"""Registered queries: the operators bound to the Parquet tables, and their SQL counterparts."""
