"""Column functions: paths, labels, regular-expression scans."""
