"""Readers and writers: records, generators, samples and logs."""
