"""Spark jobs that build, check and score labelled speech corpora."""
