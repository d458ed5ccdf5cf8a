"""Readers and writers of sales and panel data."""
