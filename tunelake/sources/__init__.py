"""Where library objects come from and where results go."""
