"""Graph, inference, statistics, ontology, sense and memory operators."""
