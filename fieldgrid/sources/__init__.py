"""Readers and writers: pixel tables, weather texts, web pages, JSON documents, vector layers, coefficient files."""
