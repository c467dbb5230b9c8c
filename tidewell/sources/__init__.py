"""Connectors: FASTX and BAM sources, FASTA, matrix and text sinks."""
