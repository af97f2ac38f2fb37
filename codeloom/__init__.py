"""codeloom: property-graph analytics over source-code snapshots, on Spark DataFrames."""
