"""streaming of jurisgrid."""
