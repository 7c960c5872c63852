"""Scanning streams."""
