"""Whole queries: operators bound to tables, and the end-to-end audit."""
