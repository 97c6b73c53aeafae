"""Row-level plans over streams of files."""
