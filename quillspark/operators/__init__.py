"""Relational and text-mining operators over DataFrames."""
