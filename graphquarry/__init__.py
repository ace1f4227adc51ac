"""graphquarry: code-search, graph and corpus analytics as Spark plans."""
