"""DataFrame → DataFrame operators: staging, goal marts, metrics, journeys, profiling,
survival, features / classifier and data-quality checks."""
