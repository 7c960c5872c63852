"""The built-in packs."""
