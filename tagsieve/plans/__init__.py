"""Session, checkpoint and registered queries."""
