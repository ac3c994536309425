"""Readers and writers, test data, simulation."""
