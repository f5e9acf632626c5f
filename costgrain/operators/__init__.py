"""operators of costgrain."""
