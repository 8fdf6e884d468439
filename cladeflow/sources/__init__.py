"""Readers and writers of tree samples, clade tables, rates, events, constraints and timings."""
