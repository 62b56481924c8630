"""Stratalens: a PySpark analytics engine for media catalogs and text corpora."""
