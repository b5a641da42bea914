"""sources of jurisgrid."""
