"""Streaming scoring of sensor messages, alerts and work orders."""
