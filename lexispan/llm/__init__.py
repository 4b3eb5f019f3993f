"""Training-data operators over ``documents`` and the queries that apply them."""
