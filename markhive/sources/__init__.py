"""Readers and writers: bookmark files, crawled pages, test fixtures."""
