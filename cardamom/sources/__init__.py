"""Readers, writers, and tables around a crawl."""
