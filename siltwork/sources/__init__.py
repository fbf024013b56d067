"""Table, image and object-store readers and writers."""
