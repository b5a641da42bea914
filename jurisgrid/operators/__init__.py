"""operators of jurisgrid."""
