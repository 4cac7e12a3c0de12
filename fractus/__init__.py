"""Spark-native engine for splitting 3-D segmentation fragments, many at a time."""

from .plans.splitters import SINK, SOURCE, STRAY, GeodesicSplitter, NoopSplitter, RidgeConnectPrep, SeedFrames, SeedPrep, SplitFrames, Splitter, WatershedSplitter

__all__ = ["SOURCE", "SINK", "STRAY", "Splitter", "SeedPrep", "SplitFrames", "SeedFrames", "GeodesicSplitter", "RidgeConnectPrep", "WatershedSplitter", "NoopSplitter"]
