"""Jobs, the query registry, and tables that cut lineage."""
