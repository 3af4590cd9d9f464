"""Readers: report exports, upload registration and page text."""
