"""Operators that prepare training text: filters, duplicates, mixing, counting, sharding and archives."""
