"""Tensors as DataFrames: layouts, sparse structures, quantization, composites and files on Spark."""
