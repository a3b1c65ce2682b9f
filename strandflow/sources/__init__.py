"""Readers and writers of sequence and alignment files."""
