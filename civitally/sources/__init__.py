"""Landed-data readers, sinks and layer storage."""
