"""Trovelode: indexing and search over source trees and text collections, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
