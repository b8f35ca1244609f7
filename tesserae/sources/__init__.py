"""Readers and writers of the relations that the operators work on."""
