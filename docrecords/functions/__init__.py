"""Column functions: text clean-up and URL handling."""
