"""relafix: whole-program dataflow analytics as relational fixpoints on Spark."""
