"""Loading members as they arrive."""
