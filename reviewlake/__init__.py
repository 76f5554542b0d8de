"""reviewlake: Spark jobs for the data work around automated code review."""
