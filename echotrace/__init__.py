"""echotrace: duplication analytics over source trees and text tables, on Spark DataFrames."""

__version__ = "0.1.0"
