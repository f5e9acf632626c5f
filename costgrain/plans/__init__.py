"""plans of costgrain."""
