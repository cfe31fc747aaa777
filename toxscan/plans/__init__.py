"""End-to-end plans built from the operators: dataset build, training, inference."""
