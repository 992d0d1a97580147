"""Column functions over boxes, cameras and text."""
