"""Where rows come from and go to: versioned tables and registered files."""

from millrace.sources.store import Catalog, Store, Table

__all__ = ["Catalog", "Store", "Table"]
