"""Operators for preparing large text and record collections; nothing outside imports this package."""
