"""Training-data operators: thirteen Spark jobs over document, page and embedding tables."""
