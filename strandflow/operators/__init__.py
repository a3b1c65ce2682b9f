"""DataFrame operators: alignments, pairs, graphs, trees, statistics, matrices."""
