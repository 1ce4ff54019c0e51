"""Table schemas, readers, writers and the durable scratch tables."""
