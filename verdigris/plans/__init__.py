"""Reports and registered queries."""
