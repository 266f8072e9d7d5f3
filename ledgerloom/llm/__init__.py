"""Operators for training data: survivors, label mapping, glyphs, leakage, mixing and encodings."""
