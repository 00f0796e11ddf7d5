"""DataFrame -> DataFrame operators (prepare, profile, rates, tests, trends, ingest, graph, split,
encode, learn, models); see README.md for the module map."""
