"""functions of jurisgrid."""
