"""Query plans: fixpoint rounds, the answer cascade and the pattern language."""
