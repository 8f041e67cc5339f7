"""Newsline: streaming."""
