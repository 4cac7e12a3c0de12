"""Operators on voxel tables, as DataFrame plans keyed by fragment."""
