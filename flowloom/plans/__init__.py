"""Session, scratch tables and query registries."""
