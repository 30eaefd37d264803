"""Operators for large-scale training-data pipelines. Nothing else in relafix imports this subpackage."""
