"""Iteration: supersteps, frontiers, materialisation."""
