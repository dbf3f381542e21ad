"""Graph operators: traversal, mutation, typed contract, semantic layer, message passing, views."""
