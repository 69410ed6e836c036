"""Where lines come from: plain and compressed files, exported results, growing files."""
