"""DataFrame-in, DataFrame-out operators over pages, lines, sections, edges and runs."""
