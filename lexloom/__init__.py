"""lexloom: Spark jobs over versioned, cited and amended documents."""
