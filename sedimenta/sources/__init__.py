"""Readers and writers for catalogues, source trees, archives and change records."""
