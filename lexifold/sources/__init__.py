"""Readers and writers for corpora, cluster paths, results and stage tables."""
