"""Foliant: readers and writers of catalogs, bodies, seeds and reports."""
