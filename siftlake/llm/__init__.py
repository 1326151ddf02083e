"""Training-data operators on Spark. Nothing else in the library imports this subpackage."""
