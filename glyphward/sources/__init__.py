"""Where texts come from and where results go."""
