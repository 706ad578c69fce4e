"""loomgraph: analytics over typed property graphs and research corpora, on PySpark."""
