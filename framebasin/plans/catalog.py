"""All registered queries."""

from . import corpora, geometry, labelling, results, selection
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpora", "geometry", "labelling", "results", "selection"]
