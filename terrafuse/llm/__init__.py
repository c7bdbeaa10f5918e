"""Operators of a training-data pipeline; nothing else in terrafuse imports this subpackage."""
