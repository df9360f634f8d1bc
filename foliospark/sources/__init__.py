"""Readers and writers of content lists, archives and reports."""
