"""prefixloom: routing-rule databases (CIDR blocks and domain rules) as Spark DataFrames."""

__version__ = "0.1.0"
