"""Searches for k-regular graphs of girth g, and their runner."""

from .methods import METHODS, BestFirst, DepthFirst, RandomWalk, TreeSearch
from .runner import compare, run, summary

__all__ = ["METHODS", "BestFirst", "DepthFirst", "RandomWalk", "TreeSearch", "compare", "run", "summary"]
