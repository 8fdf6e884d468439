"""Clade analytics on Spark: tree samples in, clade tables, likelihoods and time orders out."""
