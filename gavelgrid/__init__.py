"""gavelgrid: a Spark-native engine for document corpora, retrieval and citation data."""
