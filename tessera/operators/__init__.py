"""Reads, writes, paging and raw key ranges as DataFrame operations."""
