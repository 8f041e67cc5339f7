"""Newsline: operators."""
