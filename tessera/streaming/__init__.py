"""The change log: written by commits, read in batch, tailed with Structured Streaming, applied elsewhere."""
