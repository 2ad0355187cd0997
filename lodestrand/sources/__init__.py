"""Where lines and tables come from."""
