"""Plan patterns shared by the operators: running values, checked joins, range joins."""
