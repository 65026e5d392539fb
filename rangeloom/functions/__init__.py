"""Column functions of addresses and text."""
