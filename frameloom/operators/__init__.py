"""Operators on port columns; each is a Column expression or a DataFrame step."""
