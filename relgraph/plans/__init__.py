"""From declared meaning to operator calls: ontologies and the bridge to graphs."""
