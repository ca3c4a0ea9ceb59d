"""Changes feed and replication."""
