"""Sources and sinks: source trees, saved graphs, generated projects, graphs adapted from relational tables."""
