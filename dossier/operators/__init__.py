"""DataFrame operators: corpus building, TF-IDF, embedding, similarity, collapse, linking, ranking."""
