"""Reports, projects and registered queries, built from the operators."""
