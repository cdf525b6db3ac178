"""Training-data operators: one module for each, queries.py for the registered queries."""
