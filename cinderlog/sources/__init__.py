"""Readers for payloads, topics and tables."""
