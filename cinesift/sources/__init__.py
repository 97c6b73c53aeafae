"""What is read: folders, container metadata, images, concepts."""
