"""functions of pagefuse."""
