"""Readers and writers: wide draft logs, card metadata, groupings, stored tables."""
