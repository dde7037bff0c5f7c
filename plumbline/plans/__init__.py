"""Compositions of operators: the whole analysis and the experiment."""
