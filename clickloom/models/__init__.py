"""Fusion, prediction and graph-attention models: numpy forward passes inside Arrow batches, trained by Spark."""
