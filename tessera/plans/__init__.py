"""Query plans; importing the modules registers their queries."""
