"""Newsline: functions."""
