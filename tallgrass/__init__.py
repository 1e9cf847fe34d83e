"""Tallgrass."""
