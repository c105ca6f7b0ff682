"""Standard views, the query catalog and the staged pipeline."""
