"""sources of pagefuse."""
