"""Operators for training-data pipelines: each module holds one operator with its own interface;
``queries`` binds them to the test tables."""
