"""End-to-end workflows composed from operators, and the registered queries."""
