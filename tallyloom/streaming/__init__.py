"""Turns kept up to date while transcripts arrive."""
