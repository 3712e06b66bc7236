"""Registry of the queries."""
