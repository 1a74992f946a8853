"""Readers that turn pages, markup and dumps into block streams."""
