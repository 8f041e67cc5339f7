"""Newsline: plans."""
