"""The spatial joins every operator is assembled from."""
