"""Logical plans that many queries start from."""
