"""Preparation of training data: value mapping, grouping, packing, mixing and spam detection."""
