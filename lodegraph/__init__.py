"""A property-graph and code-intelligence engine on Spark DataFrames."""
