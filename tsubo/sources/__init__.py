"""Where tables come from and where answers go."""
