"""Readers: each turns stored text into typed rows, and bad input into reject rows."""
