"""functions of costgrain."""
