"""DataFrame to DataFrame operators: rules, detectors, scoring, de-duplication, correlation."""
