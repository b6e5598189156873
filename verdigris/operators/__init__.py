"""Checks over one table or over a source and its migrated copy."""
