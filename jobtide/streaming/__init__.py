"""Job state kept up to date by Structured Streaming."""
