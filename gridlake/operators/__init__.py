"""DataFrame -> DataFrame operators (A, J, L, P, U, W ids of the survey)."""
