"""Reports and publishing: plans composed of the operators."""
