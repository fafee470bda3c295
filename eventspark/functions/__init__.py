"""Column-level building blocks: predicates, kinematics and in-row collection functions."""
