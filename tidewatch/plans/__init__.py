"""Plan helpers: intermediate tables that cut lineage."""
