"""Operators for training data: ranking, set joins, page repair, splitting, scoring, encoding, packing, languages."""
