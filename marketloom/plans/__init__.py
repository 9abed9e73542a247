"""Jobs that a user submits, and the registered queries."""
