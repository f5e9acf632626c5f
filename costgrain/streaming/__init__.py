"""streaming of costgrain."""
