"""Reading and writing: media files, manifests, and tables partitioned by album."""
