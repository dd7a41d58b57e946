"""Graph figures kept up to date over streams."""
