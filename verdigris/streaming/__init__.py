"""Checks of tables that are still being written."""
