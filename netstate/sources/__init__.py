"""Readers and writers of state tables and raw captures."""
