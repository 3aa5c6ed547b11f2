"""Reading and writing rows, manifests and indexes."""
