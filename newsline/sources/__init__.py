"""Newsline: sources."""
