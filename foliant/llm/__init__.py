"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, apart from the guarded entry module."""
