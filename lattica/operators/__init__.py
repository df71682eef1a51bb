"""Graph, ratings, ranking and text operators."""
