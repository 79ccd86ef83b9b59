"""Analytics on gridded simulation output as lazy DataFrames."""
