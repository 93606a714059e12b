"""Live tables: versions from micro-batches, what changed between them, watches, alerts and flow control."""
