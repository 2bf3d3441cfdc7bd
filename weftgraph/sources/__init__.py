"""weftgraph.sources"""
