"""Where packets come from: files, raw tables, chunks of a live feed, generators."""
