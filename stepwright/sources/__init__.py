"""Readers, writers, row generators and providers of completions."""
