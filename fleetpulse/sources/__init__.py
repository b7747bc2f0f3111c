"""Readers, writers and the sensor view over event tables."""
