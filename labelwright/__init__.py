"""Spark jobs for cleaning, labelling and evaluating large tables of short messages."""
