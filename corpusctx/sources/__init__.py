"""Readers and writers: corpora, rule files, response logs, keyed tables."""
