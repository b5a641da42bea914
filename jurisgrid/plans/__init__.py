"""plans of jurisgrid."""
