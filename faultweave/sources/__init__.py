"""Readers and writers: event logs, the table lake and the run manifest."""
