"""graphloom: property-graph analytics over source trees, written for Spark."""
