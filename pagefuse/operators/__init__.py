"""operators of pagefuse."""
