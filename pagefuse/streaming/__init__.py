"""streaming of pagefuse."""
