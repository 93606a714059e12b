"""Sources: nested JSON feeds flattened and typed against a reviewed schema."""
