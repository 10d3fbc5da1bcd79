"""End-to-end plans and report tables built from the operators."""
