"""Jobs to be run from the command line, and as registered queries."""
