"""Column functions with the exact semantics that form data needs."""
