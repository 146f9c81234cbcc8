"""Where tables, images and trails are read from and written to."""
