"""Operators of a training-data pipeline: scoring, scans, packing, languages, chats, shards, duplicates, pages, leaks."""
