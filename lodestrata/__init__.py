"""Spark jobs over large text and source collections and the logs of the runs that use them."""
