"""Panels that are kept up to date from streams of sales."""
