"""Readers: each gives a DataFrame with an explicit position wherever order matters."""
