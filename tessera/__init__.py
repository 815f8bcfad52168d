"""Tessera: document-graph analytics and corpus preparation expressed as Spark plans."""
