"""Table operators: graph, alignments, read paths, variants, bins, model, resampling, conflicts, pangenome."""
