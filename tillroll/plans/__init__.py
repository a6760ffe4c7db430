"""Session settings, the registered query catalog with its DuckDB oracle
texts, and tools to check (``diffcheck``) and inspect (``explain``) the plans."""
