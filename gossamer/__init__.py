"""Infrastructure-graph analytics on Spark: signals in, typed graphs, spectra, links and comparisons out."""
