"""Jobs on catalogue tables."""
