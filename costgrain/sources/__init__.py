"""sources of costgrain."""
