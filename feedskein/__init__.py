"""Feeds, articles and feed discovery as Spark jobs over tables of captured documents."""
