"""Training-data operators: ten corpus-scale jobs over documents, pages, conversations and embeddings."""
