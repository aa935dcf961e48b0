"""Readers, writers and the shared scratch area."""

from scrivenry.sources.tables import materialize, shared_dir, table

__all__ = ["materialize", "shared_dir", "table"]
