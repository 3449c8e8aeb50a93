"""Graph and analysis operators over any nodes and edges."""
